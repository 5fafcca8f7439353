"""Queries against their SQL on tables with what the driver's small ones lack."""

import duckdb
import pytest

from studylake import plans


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL give the same rows over some ``documents``."""

    def check(name, texts):
        docs = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(plans.SQL[name])
        names = [d[0] for d in want.description]
        got = plans.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
        return {r[0]: r for r in got}

    return check


def test_a_quote_far_from_its_old_place_is_exact(same):
    far = "\n".join(["a line of other words"] * 30)
    found = same("anchor_migrate", ["title\nthe quoted words", f"{far}\nhere are the quoted words again", "words quoted the", "title\nwords quoted the", "nothing"])
    assert found[0].exact_match and found[0].status == "attached"


def test_all_rules_of_artifacts_are_in_the_sql(same):
    bullets = ["- a\n* b\n  - c\n\n-d\n*e\n- f", "- a\n- b\n- c\n- d\n- e\nno - bullet", "- a\r- b\r\n- c - d  - e\n\n\x0b* f", "- a\x85- b\x0b- c\n- d\n- e\n- f"]
    half = ["word " * 300, "word " * 300, "word\x0b" * 451, "", "  ", None, "\n"]
    texts = [t for pair in zip([*bullets, "", "word　" * 151, None], half) for t in pair]
    found = same("artifact_validate", texts)
    assert [found[i].problems for i in (0, 2, 4, 6, 8, 10)] == ["more than 5 bullets", "", "more than 5 bullets", "", "text is required", "more than 150 words"]
    assert [found[i].problems for i in (1, 3, 7, 11)] == ["", "", "text is required, not 300 to 450 words", "text is required"]
