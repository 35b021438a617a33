"""Store options: checked when made, written when a root is first opened, compared field by field later."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from .files import Files

FILE = "options.json"


class OptionsError(ValueError):
    pass


@dataclass(frozen=True)
class StoreOptions:
    """segment_size bounds the rows of a data file; memtable_entries is the pending rows at which a store commits by itself;
    merge_fanout segments of a level are merged; max_segment_entries bounds an index file's rows; fence_stride is its rows per
    page; bloom_bits_per_key turns Parquet's Bloom filters on or, at 0, off. block_size, cache_budget_bytes and write_buffer_bytes
    are kept for the reopen check: Spark manages pages, memory and buffers."""

    block_size: int = 4096
    cache_budget_bytes: int = 20 << 30
    segment_size: int = 1 << 30
    memtable_entries: int = 1 << 20
    merge_fanout: int = 4
    max_segment_entries: int = 1 << 27
    fence_stride: int = 4096
    bloom_bits_per_key: int = 10
    write_buffer_bytes: int = 1 << 20
    report_maintenance_progress: bool = True

    def validate(self) -> StoreOptions:
        checks = (
            (self.block_size >= 512 and self.block_size & (self.block_size - 1) == 0, "block_size must be a power of two of at least 512"),
            (self.cache_budget_bytes >= 16 * self.block_size, "cache_budget_bytes must hold 16 blocks"),
            (self.segment_size >= self.block_size, "segment_size must be at least a block"),
            (self.memtable_entries >= 1024, "memtable_entries must be at least 1024"),
            (self.merge_fanout >= 2, "merge_fanout must be at least 2"),
            (self.max_segment_entries >= self.memtable_entries, "max_segment_entries must be at least memtable_entries"),
            (self.fence_stride >= 16, "fence_stride must be at least 16"),
            (0 <= self.bloom_bits_per_key <= 32, "bloom_bits_per_key must be from 0 to 32"),
            (self.write_buffer_bytes >= self.block_size, "write_buffer_bytes must be at least a block"),
        )
        if wrong := [message for ok, message in checks if not ok]:
            raise OptionsError("; ".join(wrong))
        return self


def write_or_verify(files: Files, options: StoreOptions) -> None:
    """Writes the options if there are none; else every field must be as written."""
    if not files.exists(FILE):
        files.write(FILE, json.dumps(asdict(options), indent=2))
        return
    try:
        written = json.loads(files.read(FILE))
    except (json.JSONDecodeError, OSError) as e:
        raise OptionsError(f"{FILE} can't be read: {e}") from e
    if not isinstance(written, dict):
        raise OptionsError(f"{FILE} holds no options")
    now = asdict(options)
    if different := [f"{k} was {written.get(k)!r} and is now {v!r}" for k, v in now.items() if written.get(k) != v]:
        raise OptionsError("the options differ from those the root was made with: " + ", ".join(different))
