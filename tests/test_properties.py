"""Property checks (hypothesis) for the loose-number helpers against the D-19 rule:
integers parse exactly, decimal text truncates toward zero, anything else -> default."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.functions import scalars

INTS = st.integers(min_value=-(2 ** 53), max_value=2 ** 53)
FLOATS = st.floats(min_value=-1e12, max_value=1e12, allow_nan=False, allow_infinity=False)
JUNK = st.text(alphabet="abcxyz-_/ ", min_size=1, max_size=6).filter(lambda s: s.strip() not in ("", "-"))


def expected_int(text: str, default: int = 0) -> int:
    t = text.strip()
    try:
        return int(t)
    except ValueError:
        try:
            f = float(t)
        except ValueError:
            return default
        return default if math.isnan(f) or math.isinf(f) else int(f)  # int() truncates


@settings(max_examples=5, deadline=None)
@given(ints=st.lists(INTS, min_size=20, max_size=20), floats=st.lists(FLOATS, min_size=20, max_size=20),
       junk=st.lists(JUNK, min_size=5, max_size=5))
def test_safe_int_matches_rule(spark, ints, floats, junk):
    texts = [str(i) for i in ints] + [repr(f) for f in floats] + junk
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(scalars.safe_int("x", 0)).collect()]
    assert got == [expected_int(t) for t in texts]
    gotf = [r[0] for r in df.select(scalars.safe_float("x", 0.0)).collect()]
    for t, g in zip(texts, gotf):
        try:
            want = float(t)
        except ValueError:
            want = 0.0
        assert g == want


@settings(max_examples=5, deadline=None)
@given(uids=st.lists(st.integers(min_value=-10, max_value=5000), min_size=30, max_size=30))
def test_map_uid_rule(spark, uids):
    df = spark.createDataFrame([(u,) for u in uids], "x long")
    got = [r[0] for r in df.select(scalars.map_uid("x")).collect()]
    assert got == [0 if u == 0 else 1 if 0 < u < 1000 else u for u in uids]
