"""Fill-in-the-middle against a plain version of its definition."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.infilling import fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.withColumns({c: F.lit("x") for c in extra.split()})
    made = fill_in_middle(docs)
    back = made.select(*made.columns, restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in back))) == sorted(map(repr, (plainly(*r) for r in rows)))
    kept = {repr((i, t or "")) for i, t in rows}
    assert all(repr((r.doc_id, r.back)) in kept for r in back)


def test_odd_rows(spark):
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", "a b  c\n\n", "é ü　x y 𝒳𝒴 z", "<P> a", "a <S", "<S<S> b", "x<M>", "<", "<P <S <M <P", "P> S> M>", "a" * 5000, "w " * 30000, "\x0b\x0c\x1c\x85 q"]
    check(spark, [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(12)])


def test_repeated_rows_null_keys_and_clashing_names(spark):
    rows = [(7, "one two three four")] * 5 + [(7, "one two three five")] * 2 + [(None, "one two three four")] * 3 + [(0, "one two three four")] * 2 + [(i, "same text here") for i in range(40)]
    check(spark, rows, extra="n k d form output times ordinal unit low high p q")


def test_empty_table(spark):
    check(spark, [])


def test_markers_at_the_joints_come_back(spark):
    check(spark, [(i, t) for i in range(30) for t in ("a< <S <P b", "<S <S <S <S", "S> P> < <P", "< < < <")])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**12), st.text("ab <PSM>\n\té𝒳", max_size=40)), max_size=30))
def test_any_text(spark, rows):
    check(spark, rows)


def test_integer_keys(spark):
    docs = spark.createDataFrame([(3, "a b c d e f")], "doc_id int, text string")
    assert tuple(fill_in_middle(docs).first())[:6] == plainly(3, "a b c d e f")
