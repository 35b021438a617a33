"""Command line: python -m ordinalis.cli COMMAND ROOT ... Exit codes: 0 done, 1 unknown command or bad arguments, 2 nothing found."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import lookup
from .plans.compaction import Progress
from .root import LedgerRoot
from .session import session
from .sources import synthetic
from .sources.options import StoreOptions

SHOWN = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ordinalis", exit_on_error=False)
    p.add_argument("command", choices=["ingest-transactions", "ingest-addresses", "find-v0", "find-v1", "find-v2", "find-v3", "find-id", "find-address", "maintain", "stats"])
    p.add_argument("root")
    p.add_argument("value", nargs="?", help="a key or an address")
    p.add_argument("--count", type=int, default=1_000_000)
    p.add_argument("--keys", type=int, help="distinct keys of synthetic transactions")
    p.add_argument("--cache-mb", type=int, default=256)
    p.add_argument("--memtable", type=int, default=1 << 20)
    return p


def show(rows: DataFrame) -> int:
    n = rows.count()
    print(f"{n} found")
    for row in rows.limit(SHOWN).collect():
        print("  " + "  ".join(str(x) for x in row))
    if n > SHOWN:
        print(f"  ... {n - SHOWN} more")
    return 0


class ConsoleProgress:
    """Prints a maintenance run's progress at steps of half a percent on a terminal, ten elsewhere, and at its end."""

    def __init__(self, out=None):
        self.out, self.shown = out or sys.stderr, -1.0
        self.step = 0.5 if self.out.isatty() else 10.0

    def __call__(self, p: Progress) -> None:
        if p.percentage - self.shown >= self.step or p.percentage >= 100 > self.shown:
            self.shown = p.percentage
            print(f"{p.percentage:5.1f} %  {p.stage}  {p.done:,} of {p.total:,}", file=self.out)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    with LedgerRoot(spark, args.root, StoreOptions(cache_budget_bytes=args.cache_mb << 20, memtable_entries=args.memtable)) as root:
        if args.command == "ingest-transactions":
            first = root.transactions.append_range(synthetic.transactions(spark, args.count, args.keys, root.transactions.count))
            print(f"appended {args.count} from ordinal {first}")
        elif args.command == "ingest-addresses":
            first = root.addresses.append_range(synthetic.addresses(spark, args.count, root.addresses.count))
            print(f"appended {args.count} from ordinal {first}")
        elif args.command == "maintain":
            print(f"merged {root.maintain(ConsoleProgress() if root.options.report_maintenance_progress else None)} entries")
        elif args.command == "stats":
            o = root.options
            print(f"root {root.path}\nblock size {o.block_size}\ncache blocks {o.cache_budget_bytes // o.block_size}")
            for store in (root.transactions, root.addresses):
                print(f"{store.spec.name}: {store.count} records x {store.spec.row_bytes} bytes")
                for row in store.index_statistics().collect():
                    print(f"  {row.name}: {row.segment_count} segments, {row.pending_count} pending, covered to {row.covered_up_to}")
        elif args.value is None:
            print("a value is needed", file=sys.stderr)
            return 1
        elif args.command == "find-address":
            row = lookup.first_match(root.find_address(args.value)).first()
            if row is None:
                print("not found")
                return 2
            print(row.id)
        elif args.command == "find-id":
            found = root.first_address(int(args.value))
            if found is None:
                print("not found")
                return 2
            print(found)
        else:
            return show(root.transactions_by(int(args.command[-1]), int(args.value)))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        print(e, file=sys.stderr)
        return 1
    return run(session(), args)


if __name__ == "__main__":
    sys.exit(main())
