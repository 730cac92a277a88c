"""Features against brute force over all pairs of works."""

from collections import defaultdict

from ledgerlight.operators.similarity import token_set_ratio
from ledgerlight.plans import corpus

SF = "/root/testdata/sf0.001"


def test_duplicate_similarity_is_the_best_of_all_other_works_of_the_agency(spark):
    rows = corpus.features(spark, SF, check=True).select("work_id", "agency", "description_key", "duplicate_similarity", "duplicate_similarity__why").collect()
    blocks = defaultdict(list)
    for r in rows:
        if r["agency"] is not None and r["description_key"] is not None:
            blocks[r["agency"]].append((r["work_id"], r["description_key"]))
    assert len(rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    for r in rows:
        best = max((token_set_ratio(r["description_key"], t) / 100 for i, t in blocks.get(r["agency"], ()) if i != r["work_id"]), default=None) if r["description_key"] else None
        assert r["duplicate_similarity"] == best
        assert r["duplicate_similarity__why"] == ("not_published" if not r["description_key"] else "not_applicable" if best is None else "published")
    assert any(r["duplicate_similarity"] not in (None, 0.0, 1.0) for r in rows)
