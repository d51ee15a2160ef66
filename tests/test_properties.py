"""Property tests: native expressions against their Python definitions."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stmtflow.functions.text import format_money, is_blank, parse_money, py_strip

SPACES = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029"
          "\u202f\u205f\u3000\u200b\ufeff")
text = st.text(alphabet=st.sampled_from(SPACES + "ab"), max_size=8)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(text, min_size=1, max_size=40))
def test_blank_and_strip_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", is_blank("s").alias("b"), py_strip("s").alias("t")).collect()
    for r in rows:
        v = values[r.i]
        assert r.b == (not v.strip()), repr(v)
        assert r.t == v.strip(), repr(v)


@SETTINGS
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=2, allow_nan=False), min_size=1, max_size=40))
def test_money_round_trip(spark, amounts):
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(amounts)], "i int, x double")
    rows = df.select("i", parse_money(format_money("x")).alias("m")).collect()
    for r in rows:
        assert r.m == Decimal(amounts[r.i]).quantize(Decimal("0.01")), amounts[r.i]
