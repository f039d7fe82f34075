"""Goldens of the text kernels."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lakeloom.functions import text as X


@pytest.mark.parametrize(
    "literal, scale, value",
    [("1,200", 0, "1200"), ("0.50", 0, "0.5"), ("3", 6, "3000000"), ("1.5e3", 0, "1500"), ("１２", 0, "12"), ("-0", 0, "0"), ("2.50", 3, "2500"), ("1e40", 0, "1e40"), ("0.001", 0, "0.001"), ("−7", 0, "-7"), ("12e30", 0, "1.2e31"), ("12e29", 0, "12" + "0" * 29), ("1e-21", 0, "1e-21"), ("1.5e-20", 0, "0." + "0" * 19 + "15"), ("3e1234567", 2, "literal:3e1234567*1e2")],
)
def test_canonical(literal, scale, value):
    assert X.canonical(literal, scale) == value


def test_numbers():
    assert [n["value"] for n in X.numbers("1.2 million of 3,000 (45%) v2 x1.5y 3 万")] == ["1200000", "3000", "45%", "5", "30000"]
    assert [n["value"] for n in X.numbers("½ of 2.5B parameters, 3 . 5 kg, 7B, 2 十億, ３．５％ and x9")] == ["2500000000", "3.5", "7", "2000000000", "3.5%"]


@pytest.mark.parametrize(
    "text, values",
    [("1,2345 12,345,6789 1234,567", ["1", "2345", "12345", "6789", "1234", "567"]), ("3-5, 5%-3 and a-7", ["3", "5", "5%", "-3", "7"]), ("1. 5 2 .5 2 . 5 3.4.5", ["1", "5", "2", "5", "2.5", "3.4", "5"]),
     ("2e5x 2e 1e+3% +4", ["200000", "2", "1000%", "4"]), ("7 millions 7 million. 7m 7 b models 8 十万x 9十万", ["7", "7000000", "7", "7000000000", "8", "900000"]), ("a1 _2 é3 12abc34", ["3", "12"]), ("", []), ("+3e1234567 %", ["literal:+3e1234567*1e0%"])],
)
def test_number_rules(text, values):
    assert [n["value"] for n in X.numbers(text)] == values


@given(st.decimals(allow_nan=False, allow_infinity=False, places=6), st.integers(0, 12))
def test_canonical_is_exact(x, scale):
    from fractions import Fraction

    value = X.canonical(f"{x:f}", scale)
    assert Fraction(value) == Fraction(x) * 10**scale and X.canonical(value) == value


@given(st.text("ab1,.$`{}_@/: \n", max_size=60))
def test_mask_round_trip(text):
    m = X.mask(text)
    assert X.unmask(m["masked"], m["atoms"], m["space"]) == text


def test_salvage():
    assert X.salvage('[{"b":1,"a":2}, 3, {"c":') == {"items": ['{"a": 2, "b": 1}', "3"], "complete": False}
    assert X.salvage("[1, 2]") == {"items": ["1", "2"], "complete": True}
    assert X.salvage('[1, {"a":1,"a":2}]') == {"items": ["1"], "complete": False}
    assert X.salvage("[NaN]")["items"] == [] and X.salvage(None) == {"items": [], "complete": False}


def test_blocks():
    assert X.html_rows("<h2>A &amp; b</h2><p>one<script>no</script> two<li>x") == [("heading", 2, "A & b"), ("paragraph", 0, "one two"), ("list_item", 0, "x")]
    got = [(b["kind"], b["level"], b["text"]) for b in X.markdown("# T\n\npara\nmore\n- a\n2) b\n```py\nx = 1\n```\nend")]
    assert got == [("heading", 1, "T"), ("paragraph", 0, "para more"), ("list_item", 0, "a"), ("list_item", 0, "b"), ("code", 0, "x = 1"), ("paragraph", 0, "end")]


def test_inline_tokens():
    kinds = [(t["kind"], t["text"]) for t in X.inline("see https://a.b/c, $x+y$ [1, 3–4] (Lee et al., 2020) 5 km 12 $5 and $6")]
    assert kinds == [("url", "https://a.b/c,"), ("math", "$x+y$"), ("citation", "[1, 3–4]"), ("citation", "(Lee et al., 2020)"), ("quantity", "5 km"), ("scalar", "12"), ("scalar", "5"), ("scalar", "6")]


def test_core_keeps_letters_only():
    assert X.core("Ünïted ﬁle №5") == "unitedfileno5"


def test_memory_keeps_every_hit(spark):
    short = "A Short Query"
    texts = ["intro " * 40 + short.upper() + " outro" * 40, *[f"{short} {i}" for i in range(7)], "0123456789" * 3]
    memory = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    asked = spark.createDataFrame([(1000 + i, short) for i in range(1001)], "query_id long, text string")
    assert X.ratio(short, texts[0]) < 0.35
    out = X.rank_memory(memory, asked).collect()
    want = sorted(range(8), key=lambda i: (-X.ratio(short, texts[i]), i))
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in out)
    assert got == [(q, n + 1, i) for q in range(1000, 2001) for n, i in enumerate(want)]
    assert {r["difference"] for r in out if r["item_id"] == 3} == {"- A Short Query\n+ A Short Query 2\n?              ++\n"}


def test_every_item_asks(spark, tmp_path):
    from lakeloom import plans

    spark.createDataFrame([(i, "the same words") for i in range(3, 10)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = plans.load()["similar_memory"](spark, str(tmp_path)).collect()
    assert len(out) == 7 * 6 and {r["query_id"] for r in out} == set(range(3, 10)) and {r["difference"] for r in out} == {""}
