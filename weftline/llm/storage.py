"""Files that tasks write and read by themselves, in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@contextmanager
def replacing(path: str, attempt: str):
    """A stream whose file appears under ``path`` only when it is complete. A
    task that runs twice, or at the same time as its copy, leaves one whole
    file: attempts write under names of their own and the last rename wins."""
    system, name = _resolve(path)
    folder, _, leaf = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{leaf}.{attempt}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, name)


def open_input(path: str):
    system, name = _resolve(path)
    return system.open_input_file(name)
