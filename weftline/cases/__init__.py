"""A case from its files to findings: sources, extraction, entities, graph,
detectors, reports and the engine that joins them."""
