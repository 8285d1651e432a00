"""Identities and hex text against known values of two real transactions."""

import pytest
from pyspark.sql import functions as F

from tallywheel.functions import hexes, ids, keccak

TX = "0x08c2902756cb2808c056499225d6dbd40c3e656a3b53fe9d31679fcb8dc15e96"
A, B, C = "0x3feb1e09b4bb0e7f0387cee092a52e85797ab889", "0xedf03cd5075f93174614febf9c6789a3e7581d4c", "0xbc10f2e862ed4502144c7d632a3459f49dfcdb5e"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, expected",
    [
        (lambda: ids.raw_log_id(F.lit(1), F.lit(18671459), F.lit(TX.upper().replace("X", "x")), F.lit(138)), "1f40c3052f66361555dcb6b7899adc9a937dac5a8ec4b626f70740f31345113f"),
        (lambda: ids.decoded_event_id(F.lit(1), F.lit(18671459), F.lit(TX), F.lit(138)), "f110fda808d63a8b7f5d8d2fbd0beb727ab09bfa4fd9c8e5c41958869bb67d89"),
        (lambda: ids.raw_trace_call_id(F.lit(TX), F.array().cast("array<int>")), "64b2bfe6b6c18ffefe2548a3b3166dead0b91de7e4a3d689e6aa097502b139b0"),
        (lambda: ids.raw_trace_call_id(F.lit(TX), F.array(F.lit(0))), "732fcbad5b03134b91fa6a6767a85c01e3cd952049614a80c3b78e843fe5ba0c"),
        (lambda: ids.movement_id(F.lit(1), F.lit(TX), F.lit(A), F.lit(B), F.lit("146492534952176000000").cast("decimal(38,0)"), F.lit(138)), "df44807deef23a67a68c34bc9e35e1bd7afd084c39b764b8c9ccd5b88539941f"),
        (lambda: ids.action_id(F.lit("d2c5d184a172d100516e30e174d36eca79b28092dae3c79089d94c3fd91c0f2f"), F.lit("stake")), "83a6e0f3be2d0752cbcd512fc291f3f9e627e7d662c73cc3ad92b64e14a4982f"),
        (lambda: ids.ledger_entry_id(F.lit("83a6e0f3be2d0752cbcd512fc291f3f9e627e7d662c73cc3ad92b64e14a4982f"), F.lit(0)), "60be71a3eeb8f798ad868bbe544fda73928ba263410b56eba96c187556bb2c8e"),
        (lambda: ids.edge_id(F.lit("83a6e0f3be2d0752cbcd512fc291f3f9e627e7d662c73cc3ad92b64e14a4982f"), F.lit("c517c54fbd534d793483205479969eee2b7098bcd21113647596fcad0aa7431d"), F.lit("exact"), F.lit(0)), "30f79a9941761882c4de42b27ed404cf708cd07a200cdab801545775012836a7"),
    ],
)
def test_known_ids(spark, make, expected):
    assert value(spark, make()) == expected


def test_null_parts_count_as_empty(spark):
    assert value(spark, ids.key(F.lit("a"), F.lit(None), F.lit("b"))) == "a||b"


@pytest.mark.parametrize("path, folded", [([], "0"), ([0, 2], "2"), ([1, 2], str((1 << 16) | 2)), ([3, 1, 4, 1, 5], str((((3 << 16 | 1) << 16 | 4) << 16 | 1) << 16 | 5))])
def test_folded_paths(spark, path, folded):
    assert value(spark, ids.trace_occurrence(F.array(*[F.lit(p) for p in path]).cast("array<int>"))) == folded


def test_keccak():
    assert keccak.topic0("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak.selector("transferFrom(address,address,uint256)") == "0x23b872dd"
    assert keccak.eip1967_slot("eip1967.proxy.implementation") == "0x360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc"
    assert keccak.keccak256(b"").hex().startswith("c5d2460186f7233c")
    assert keccak.signature({"name": "f", "inputs": [{"type": "tuple[]", "components": [{"type": "address"}, {"type": "uint256"}]}]}) == "f((address,uint256)[])"
    with pytest.raises(ValueError):
        keccak.topic0("Transfer(address indexed, address)")


@pytest.mark.parametrize("n", [0, 1, 2**64 - 1, 2**64, 10**37, 10**38 - 1])
def test_words(spark, n):
    assert value(spark, hexes.word_to_decimal(F.lit(format(n, "064x")))) == n


def test_words_out_of_range(spark):
    assert value(spark, hexes.word_to_decimal(F.lit(format(10**38, "064x")))) is None
    assert value(spark, hexes.word_to_decimal(F.lit("ff" * 32))) is None
    assert value(spark, hexes.topic_to_address(F.lit("0x1234"))) is None
    assert value(spark, hexes.method_selector(F.lit("0xA9059CBB00"))) == "0xa9059cbb"
    assert value(spark, hexes.method_selector(F.lit(None).cast("string"))) == "0x"
    assert value(spark, hexes.parse_path(F.lit("0,2,1"))) == [0, 2, 1]
    assert value(spark, hexes.parse_path(F.lit("[]"))) == []
