"""The committed state of a store: which batches of rows and which index segments count. Replaced in one step; all else on disk is ignored."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from .files import Files

FILE = "_manifest.json"


class ManifestError(ValueError):
    pass


@dataclass
class Batch:
    path: str
    first: int
    rows: int


@dataclass
class Segment:
    """A sorted run of postings, one file, of ordinals below covered_up_to; keys are compared as longs."""

    path: str
    level: int
    entries: int
    covered_up_to: int
    min_key: int
    max_key: int


@dataclass
class Manifest:
    committed: int = 0
    next_id: int = 0
    batches: list[Batch] = field(default_factory=list)
    indexes: dict[str, list[Segment]] = field(default_factory=dict)
    #: Names of streaming batches that are in, so that a replay does nothing.
    tokens: dict[str, int] = field(default_factory=dict)
    #: State that its owner commits along with the rows.
    attached: dict = field(default_factory=dict)

    def covered(self, index: str) -> int:
        return max((s.covered_up_to for s in self.indexes.get(index, [])), default=0)


def read(files: Files, folder: str) -> Manifest:
    """The manifest; a new store's is empty. Data without a manifest is an error rather than taken for nothing."""
    if not files.exists(f"{folder}/{FILE}"):
        if files.names(f"{folder}/data"):
            raise ManifestError(f"{folder} has data but no manifest")
        return Manifest()
    try:
        x = json.loads(files.read(f"{folder}/{FILE}"))
        return Manifest(x["committed"], x["next_id"], [Batch(**b) for b in x["batches"]], {k: [Segment(**s) for s in v] for k, v in x["indexes"].items()}, x["tokens"], x.get("attached", {}))
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise ManifestError(f"the manifest of {folder} can't be read: {e}") from e


def write(files: Files, folder: str, manifest: Manifest) -> None:
    files.write(f"{folder}/{FILE}", json.dumps(asdict(manifest)))
