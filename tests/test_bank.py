import pytest

from strataloom.sources import files
from strataloom.sources.bank import Bank, load_tsv_bank, read_bank

TIERS = {"MO": "morph", "TX": "tx"}


def make(spark, concepts=(), prompts=()):
    c = [("MO-0001", "gland", "morph", None, None, "s", "own", "colon", "cell", None), ("TX-0002", "wnt", "tx", None, None, "s", "own", None, None, "program"), *concepts]
    p = [(i, n, t, s, f"{n} {s}", "shared") for i, n, t in (("MO-0001", "gland", "morph"), ("TX-0002", "wnt", "tx")) for s in ("human", "mouse")]
    return Bank(spark.createDataFrame(c, files.CONCEPTS), spark.createDataFrame([*p, *prompts], files.PROMPTS))


def rules(df):
    return {r.rule for r in df.collect()}


def test_sound_bank(spark, tmp_path):
    bank = make(spark)
    assert rules(bank.violations(["human", "mouse"])) == set()
    bank.write(f"{tmp_path}/b")
    back = read_bank(spark, f"{tmp_path}/b", ["mouse", "human"])
    assert back.concepts.count() == 2 and back.provenance().first().provenance == "own"


@pytest.mark.parametrize(
    "concepts,prompts,rule",
    [
        ([("MO-0001", "gland", "morph", None, None, "s", "own", "colon", "cell", None)], [], "duplicate"),
        ([("MO-0009", "x", "morph", None, None, "s", "own", "colon", "cell", None)], [], "reference"),
        ([], [("XX-0001", "x", "morph", "human", "t", "shared")], "reference"),
        ([], [("MO-0001", "other", "morph", "human", "t", "shared")], "inconsistent concept_name"),
        ([], [("MO-0001", "gland", "tx", "human", "t", "shared")], "inconsistent tier"),
        ([], [("MO-0001", "gland", "morph", "rat", "t", "shared")], "categories"),
        ([], [("MO-0001", "gland", "morph", "human", "t", "mixed")], "not uniform"),
    ],
)
def test_broken_banks_are_named(spark, tmp_path, concepts, prompts, rule):
    bank = make(spark, concepts, prompts)
    assert rule in rules(bank.violations(["human", "mouse"]))
    bank.write(f"{tmp_path}/b")
    with pytest.raises(Exception):
        read_bank(spark, f"{tmp_path}/b", ["human", "mouse"])


def test_row_rules(spark):
    bad = [("MO-1", "a", "morph", None, None, "s", "own", "colon", "cell", None), ("TX-0003", "b", "morph", None, None, "s", "own", None, "cell", None), ("TX-0004", "c", "tx", None, None, "s", "own", None, None, None), ("ZZ-0001", "d", "none", None, None, "s", "own", None, None, None)]
    got = {(r.rule, r.key) for r in make(spark, bad).row_violations({v: k for k, v in TIERS.items()}, ["cell"], "morph", ["tx"]).collect()}
    assert got == {("id", "MO-1"), ("id", "TX-0003"), ("organ and level", "TX-0003"), ("concept type", "TX-0004"), ("tier", "ZZ-0001"), ("id", "ZZ-0001")}


def test_tsv_bank_refuses_unknown_status(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("concept_id\tconcept_name\torgan\nMO-0001\t gland \t\n")
    (tmp_path / "p.tsv").write_text("concept_id\tconcept_name\tspecies\tprompt_text\tspecies_status\nMO-0001\tgland\thuman\tt\tunheard\n")
    bank = load_tsv_bank(spark, [f"{tmp_path}/c.tsv"], f"{tmp_path}/p.tsv", TIERS, {"old": "shared"})
    c = bank.concepts.first()
    assert (c.concept_name, c.organ, c.tier) == ("gland", None, "morph")
    with pytest.raises(Exception, match="not in mapping"):
        bank.prompts.collect()
