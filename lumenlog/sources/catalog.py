"""Saved queries: a local list that shadows a shared one, kept as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class SavedQuery:
    title: str
    query: str
    chart: str = ""
    axis: str = ""
    series: str = ""


def load(path: str | Path) -> list[SavedQuery]:
    """The queries of a file; none if it isn't there."""
    p = Path(path)
    if not p.exists():
        return []
    names = [f.name for f in fields(SavedQuery)]
    return [SavedQuery(**{n: e.findtext(n) or "" for n in names}) for e in ET.parse(p).getroot().findall("query")]


def store(path: str | Path, queries: list[SavedQuery]) -> None:
    root = ET.Element("queries")
    for q in queries:
        e = ET.SubElement(root, "query")
        for name, value in asdict(q).items():
            ET.SubElement(e, name).text = value
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


class Catalog:
    """Local entries over those of a shared file, by title."""

    def __init__(self, local: str | Path, shared: str | Path | None = None):
        self.local, self.shared = Path(local), shared

    def all(self) -> list[SavedQuery]:
        both = {q.title: q for q in (load(self.shared) if self.shared else [])} | {q.title: q for q in load(self.local)}
        return sorted(both.values(), key=lambda q: q.title)

    def get(self, title: str) -> SavedQuery | None:
        return next((q for q in self.all() if q.title == title), None)

    def save(self, query: SavedQuery) -> None:
        store(self.local, sorted([q for q in load(self.local) if q.title != query.title] + [query], key=lambda q: q.title))

    def remove(self, title: str) -> None:
        store(self.local, [q for q in load(self.local) if q.title != title])
