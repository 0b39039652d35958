import hashlib
from collections import Counter, defaultdict

from llm_cases import documents, mixed_rows

from sensorloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_against_brute_force(spark):
    rows = mixed_rows()
    got = Counter(tuple(r) for r in exact_duplicates(documents(spark, rows)).select("doc_id", "keep_id", "group_size", "text_sha256").collect())
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    assert max(map(len, groups.values())) > len(rows) // 4  # cut into chunks
    want = Counter((i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert got == want


def test_one_row_of_each_text_stays(spark):
    rows = mixed_rows()
    df = documents(spark, rows).repartition(7)
    kept = exact_duplicates(df).where("kept")
    assert kept.count() == len({lower(r[1]) for r in rows}) == kept.select("text_sha256").distinct().count()
    whole = drop_exact_duplicates(df)
    assert whole.columns == df.columns
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in kept.collect())
    assert Counter(map(tuple, whole.collect())) - Counter(map(tuple, df.collect())) == Counter()


def test_null_identifiers_and_empty_table(spark):
    df = documents(spark, mixed_rows()[:1]).selectExpr("cast(null as long) doc_id", "text")
    got = exact_duplicates(df.union(df)).collect()
    assert [r.keep_id for r in got] == [None, None] and sum(r.kept for r in got) == 1
    assert exact_duplicates(df.limit(0)).count() == 0
