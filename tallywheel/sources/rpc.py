"""JSON-RPC reads as a Spark data source: one partition for each window of blocks.

The node is reached through a client object that the caller gives, so the module needs no network
library. ``fetch`` halves a window that the node refuses and goes on, down to a least size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_WINDOW, LEAST_WINDOW = 2000, 32
LOG_SCHEMA = "chain_id int, block_number long, block_hash string, tx_hash string, tx_index int, log_index int, address string, topics array<string>, data string"


def windows(first: int, last: int, size: int = FIRST_WINDOW) -> Iterator[tuple[int, int]]:
    for a in range(first, last + 1, size):
        yield a, min(a + size - 1, last)


def fetch(get: Callable[[int, int], list], first: int, last: int, size: int = FIRST_WINDOW, least: int = LEAST_WINDOW) -> Iterator[list]:
    """Results for consecutive windows; an error halves the window, and below the least one it is raised."""
    at = first
    while at <= last:
        end = min(at + size - 1, last)
        try:
            got = get(at, end)
        except Exception:
            if size // 2 < least:
                raise
            size //= 2
            continue
        yield got
        at = end + 1


def in_batches(get: Callable[[list], list], keys: list, size: int = 50) -> Iterator:
    for i in range(0, len(keys), size):
        yield from get(keys[i : i + size])


class _Window(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        o = self.options
        return [_Window(a, b) for a, b in windows(int(o["from_block"]), int(o["to_block"]), int(o.get("window", FIRST_WINDOW)))]

    def read(self, partition):
        import importlib

        module, _, name = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), name)(self.options.get("url"))
        columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        for part in fetch(lambda a, b: client.get_logs(self.options.get("address"), a, b), partition.first, partition.last):
            for log in part:
                yield tuple(log.get(c) for c in columns)


class ChainLogs(DataSource):
    """``spark.read.format("chain_logs")`` with options client ('module:factory'), url, address, from_block, to_block, window."""

    @classmethod
    def name(cls):
        return "chain_logs"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema):
        return LogReader(self.options)
