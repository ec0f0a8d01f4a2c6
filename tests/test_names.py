from weftline.operators.names import resolve, similarity, skeleton


def test_similarity_rules():
    assert similarity("V. Korda", "Korda Viktor") == 1.0
    assert similarity("Dorota Rubin", "Dorota Klara Rubin") == 1.0
    assert similarity("R. Klara", "Dorota Klara Rubin") < 0.75
    assert similarity("Viktor Korda", "Viktor Janda") == 0.5
    assert similarity("Mr. Hanasena", "hansn") == 1.0 and skeleton("Phillip") == "flp"
    assert similarity(None, "") == 0.0 == similarity("A B", "Anna Bell")


def test_resolve_by_identifier_name_and_neither(spark):
    rows = [(1, "Viktor Korda", ["p1"]), (2, "Korda V.", None), (3, "Unknown", ["p1", None]), (4, "R. Klara", []), (5, "Dorota Klara Rubin", ["p2"]), (6, None, ["p2"]), (7, None, None), (8, "R. Klara", None), (8, "R. Klara", None)]
    table = spark.createDataFrame(rows, "id long, name string, identifiers array<string>")
    assert sorted(map(tuple, resolve(table).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 4)]
    assert resolve(table.limit(0)).count() == 0
