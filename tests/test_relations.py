"""Relations that follow from the algorithms, on the driver's tables."""

from __future__ import annotations

import numpy as np

from lectern.functions import text as tx
from lectern.plans import queries as q


def test_lower_lambda_is_no_less_diverse(spark, sf_dir):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    lists: dict = {}
    for r in q.lambda_sweep(spark, sf_dir).collect():
        lists.setdefault((r.lam, r.query_id), {})[r.pick] = r.doc_id

    def diversity(ids):
        v = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
        return 1 - (v @ v.T)[np.triu_indices(len(v), 1)].mean()

    mean = {lam: np.mean([diversity(p.values()) for (x, _), p in lists.items() if x == lam]) for lam in (1.0, 0.7, 0.3)}
    assert mean[1.0] <= mean[0.7] <= mean[0.3]
    # whatever lambda is, the first pick is the one most like the seed
    assert all(len({lists[(lam, s)][1] for lam in (1.0, 0.7, 0.3)}) == 1 for _, s in lists)


def test_survivors_leak_no_group(spark, sf_dir):
    groups = {r.doc_id: r.lineage_group for r in q.lineage_groups(spark, sf_dir).collect()}
    assert groups
    seen = set()
    for r in q.near_dup_groups(spark, sf_dir).collect():
        if r.doc_id in groups:
            assert (r.query_id, groups[r.doc_id]) not in seen
            seen.add((r.query_id, groups[r.doc_id]))


def test_redaction_of_pairs(spark):
    """Texts and what becomes of them."""
    pairs = {
        "write to jane.doe+x@mail.example.org today": "write to [email redacted] today",
        "id 078-05-1120.": "id [id redacted].",
        "card 4111-1111-1111-1111 and 4111111111111111": "card [number redacted] and [number redacted]",
        "call +1 (202) 555 0143 or 020 7946 0958": "call [number redacted] or [number redacted]",
        "NIST SP 800-207, 2024-01-15, page 12345678": "NIST SP 800-207, 2024-01-15, page 12345678",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in pairs], "text string")
    got = {r.text: r.redacted for r in rows.select("text", tx.redact(rows.text).alias("redacted")).collect()}
    assert got == pairs


def test_redaction_of_numbers_in_a_row(spark):
    """The match before takes up the space, so the sign bounds the next number; letters beyond ASCII bound numbers too."""
    pairs = {
        "from 16.56.229.89 +1 (569) 555-5108 on": "from [number redacted] +[number redacted] on",
        "020 7946 0958\n020 7946 0958": "[number redacted]\n[number redacted]",
        "é078-05-1120 ü4111111111111111é": "é[id redacted] ü[number redacted]é",
    }
    rows = spark.createDataFrame([(k,) for k in pairs], "text string")
    got = {r.text: r.redacted for r in rows.select("text", tx.redact(rows.text).alias("redacted")).collect()}
    assert got == pairs
