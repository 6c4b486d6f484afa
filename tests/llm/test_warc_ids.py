import hashlib

from sqlcurate.llm.queries import QUERIES

BODY = "<p>" + "same " * 40


def test_ids_of_either_sign(spark, tmp_path):
    """The smallest id of equal payloads is the response, also below zero; ids, addresses and payloads may be null."""
    rows = [(-5, "http://a/", BODY), (3, "http://b/", BODY), (0, None, BODY), (-7, "u", "short"), (7, "u", "short"), (None, "n", BODY), (8, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op6_warc_transactions"](spark, str(tmp_path)).collect()
    digest = lambda body: hashlib.sha256((body or "").encode()).hexdigest()
    want = [(i, len(body or ""), digest(body), *(("revisit", -5) if body == BODY and i != -5 else ("response", None))) for i, _, body in rows]
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in order) for r in got), key=repr) == sorted(want, key=repr)
