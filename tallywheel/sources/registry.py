"""Contracts, their phases and ABIs, loaded on the driver and used as small dimension tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.functions import keccak
from tallywheel.functions.abi import is_nested

ZERO = "0x" + "0" * 40
_SENT_ROWS = 10_000
_INPUT = "array<struct<name:string,type:string,indexed:boolean>>"


@dataclass(frozen=True)
class Phase:
    address: str
    role: str
    abi_version: str
    from_block: int
    to_block: int | None
    abi: str | None = None
    deployed_block: int = 0
    implementation: str | None = None


def _dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds; one of at most ``_SENT_ROWS`` is sent to every executor where it is joined."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= _SENT_ROWS else df


def validate(phases: list[Phase]) -> None:
    """Phases of a contract must not overlap, and an open one must be the last."""
    by: dict[str, list[Phase]] = {}
    for p in phases:
        by.setdefault(p.address, []).append(p)
    for address, own in by.items():
        own = sorted(own, key=lambda p: p.from_block)
        for p, q in zip(own, own[1:], strict=False):
            if p.to_block is None or q.from_block <= p.to_block:
                raise ValueError(f"{address}: phase {q.abi_version} overlaps {p.abi_version}")


def _documents(folder: Path) -> list[dict]:
    out = [json.loads(p.read_text()) for p in sorted(folder.glob("*.json"))]
    if found := sorted(folder.glob("*.yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("contract files in YAML need the yaml package; JSON files need nothing") from e
        out += [yaml.safe_load(p.read_text()) for p in found]
    return out


@dataclass(frozen=True)
class Registry:
    phases: tuple[Phase, ...]
    abis: dict[str, list[dict]]

    @classmethod
    def load(cls, contracts_dir: str, abis_dir: str) -> Registry:
        """Read contract files and the ABI files they name; a missing ABI raises FileNotFoundError.

        Contracts at the zero address are placeholders and are skipped.
        """
        phases, abis = [], {}
        for doc in _documents(Path(contracts_dir)):
            for c in doc.get("contracts", []):
                address = c["address"].lower()
                if address == ZERO:
                    continue
                for p in c.get("phases", []):
                    name = p.get("abi_file")
                    if name and name not in abis:
                        abis[name] = json.loads((Path(abis_dir) / name).read_text())
                    phases.append(Phase(address, c["role"], p["abi_version"], p["from_block"], p.get("to_block"), name, c.get("deployed_block", 0), p.get("implementation")))
        return cls.of(phases, abis)

    @classmethod
    def of(cls, phases: list[Phase], abis: dict[str, list[dict]]) -> Registry:
        validate(phases)
        return cls(tuple(phases), abis)

    def addresses(self) -> list[str]:
        return sorted({p.address for p in self.phases})

    def is_known(self, address: str) -> bool:
        return self.role(address) is not None

    def role(self, address: str) -> str | None:
        return next((p.role for p in self.phases if p.address == address.lower()), None)

    def phase(self, address: str, block: int) -> Phase:
        own = [p for p in self.phases if p.address == address.lower()]
        for p in own:
            if p.from_block <= block and (p.to_block is None or block <= p.to_block):
                return p
        raise KeyError(f"{address} at block {block}")

    def list_active(self, block: int) -> list[str]:
        return sorted({p.address for p in self.phases if p.deployed_block <= block and p.from_block <= block and (p.to_block is None or block <= p.to_block)})

    def phase_table(self, spark: SparkSession) -> DataFrame:
        rows = [(p.address, p.role, p.abi_version, p.from_block, p.to_block, p.abi, p.deployed_block, p.implementation) for p in self.phases]
        return _dimension(spark, rows, "phase_address string, role string, abi_version string, from_block long, to_block long, abi string, deployed_block long, implementation string")

    def role_table(self, spark: SparkSession) -> DataFrame:
        return _dimension(spark, sorted({(p.address, p.role) for p in self.phases}), "role_address string, role string")

    def _items(self, kind: str) -> list[tuple]:
        """ABI, key, name and inputs; an anonymous event has no key. Of items with one key in an ABI the first."""
        rows: dict[tuple, tuple] = {}
        for name, items in self.abis.items():
            for item in items:
                if item.get("type") != kind:
                    continue
                text = keccak.signature({"name": "", **item})
                key = None if item.get("anonymous") else keccak.topic0(text) if kind == "event" else keccak.selector(text)
                inputs = [(i.get("name") or f"arg{k}", keccak.canonical_type(i), bool(i.get("indexed"))) for k, i in enumerate(item.get("inputs", []))]
                rows.setdefault((name, key), (name, key, item.get("name") or "<unnamed>", inputs))
        return list(rows.values())

    def has_nested(self, kind: str) -> bool:
        """Whether any event or function has an array or a tuple."""
        return any(is_nested(t) for *_, inputs in self._items(kind) for _, t, _ in inputs)

    def event_table(self, spark: SparkSession) -> DataFrame:
        """One row for each ABI and topic, so overloaded names are told apart."""
        return _dimension(spark, self._items("event"), f"abi string, topic0 string, event_name string, inputs {_INPUT}")

    def method_table(self, spark: SparkSession) -> DataFrame:
        return _dimension(spark, self._items("function"), f"abi string, selector string, method_name string, inputs {_INPUT}")


def in_phase(rows: DataFrame, phases: DataFrame, address: str, block: str, how: str = "left") -> DataFrame:
    """``rows`` with the phase that covers their block; an equi-join on the address with a range condition."""
    on = (F.lower(rows[address]) == phases["phase_address"]) & (rows[block] >= phases["from_block"]) & (rows[block] <= F.coalesce(phases["to_block"], F.lit(2**63 - 1)))
    return rows.join(phases, on, how)


def in_phase_by_bins(rows: DataFrame, phases: DataFrame, address: str, block: str, bin_blocks: int = 100_000) -> DataFrame:
    """As ``in_phase`` for tables of phases that are too large to be sent to all executors.

    Blocks are dealt into bins of ``bin_blocks``, and a phase stands in each bin that it reaches, so that the
    rows of one busy address go to as many places as it has bins. Phases without an end reach up to the
    last block of ``rows``.
    """
    last = rows.agg(F.max(block)).first()[0]
    ends = phases.withColumn("_end", F.least(F.coalesce("to_block", F.lit(2**63 - 1)), F.lit(last if last is not None else -1)))
    reached = ends.where("from_block <= _end").withColumn("_bin", F.explode(F.sequence(F.expr(f"from_block div {bin_blocks}"), F.expr(f"_end div {bin_blocks}"))))
    given = rows.withColumns({"_of": F.lower(address), "_bin": F.expr(f"`{block}` div {bin_blocks}")})
    met = (given["_of"] == reached["phase_address"]) & (given["_bin"] == reached["_bin"]) & (given[block] >= reached["from_block"]) & (given[block] <= reached["_end"])
    return given.join(reached, met, "left").drop("_of", "_end", given["_bin"], reached["_bin"])
