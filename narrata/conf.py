"""Layered INI configuration: later layers win, given arguments win over all."""

from __future__ import annotations

import configparser
import shutil
from pathlib import Path
from typing import Any


def _value(raw: str) -> Any:
    low = raw.strip().lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    for kind in (int, float):
        try:
            return kind(low)
        except ValueError:
            pass
    return raw.strip()


def load(path: str | Path) -> dict[str, Any]:
    """Keys of all sections of one file; empty values don't count."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read(path, encoding="utf-8")
    return {k: _value(v) for s in parser.sections() for k, v in parser.items(s) if v.strip()}


def layers(book: str | Path | None = None, explicit: str | Path | None = None, user: str | Path | None = None, project: str | Path | None = None) -> list[Path]:
    """Files that exist, lowest first: the user's, the project's, the book's (its own name, else audiobook.ini), the one given (a folder means the
    book's name in it). A given one that isn't there is an error."""
    found = [Path(p) for p in (user, project) if p and Path(p).is_file()]
    if book:
        book = Path(book)
        found += [p for p in (book.with_suffix(".ini"), book.parent / "audiobook.ini") if p.is_file()][:1]
    if explicit:
        path = Path(explicit)
        path = path / f"{Path(book).stem}.ini" if path.is_dir() and book else path
        if not path.is_file():
            raise FileNotFoundError(path)
        found.append(path)
    return found


def merged(files: list[Path], arguments: dict[str, Any] | None = None) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for f in files:
        out |= load(f)
    return out | {k: v for k, v in (arguments or {}).items() if v is not None}


def snapshot(conf: dict[str, Any], path: str | Path, section: str = "run") -> None:
    """What a run was started with; None and False are left out."""
    parser = configparser.ConfigParser(interpolation=None)
    parser[section] = {k: str(v) for k, v in sorted(conf.items()) if v is not None and v is not False}
    with open(path, "w", encoding="utf-8") as f:
        parser.write(f)


def point_to_book(output: str | Path, book: str | Path) -> None:
    """Remember, in the output folder, the book that it was made from."""
    folder = Path(output) / "_state"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "book_source.txt").write_text(str(Path(book).resolve()), encoding="utf-8")


def source_book(output: str | Path) -> Path | None:
    """The remembered book; None where none is."""
    try:
        text = (Path(output) / "_state" / "book_source.txt").read_text(encoding="utf-8").strip()
    except FileNotFoundError:
        return None
    return Path(text) if text else None


def copied_book(book: str | Path, folder: str | Path) -> tuple[Path, bool]:
    """The book's copy in a folder, and whether it had to be made: one of the same size and second of change is taken for the same."""
    book, target = Path(book), Path(folder) / Path(book).name
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists():
        a, b = book.stat(), target.stat()
        if (a.st_size, int(a.st_mtime)) == (b.st_size, int(b.st_mtime)):
            return target, False
    shutil.copy2(book, target)
    return target, True
