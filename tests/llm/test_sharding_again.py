"""A corpus that was sharded before, or has columns of the outputs' names, can be sharded."""

from evalspark.llm.hilbert import shard_documents


def test_outputs_take_the_place_of_columns_with_their_names(spark):
    rows = [(k, f"text {k} " * (k % 5), "en", "s", k, 7, "old", 3) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _shard int, _Size string, _slot int")
    once = shard_documents(docs, 4)
    assert once.columns == ["doc_id", "text", "lang", "source", "n_chars", "_size", "_hilbert", "_shard", "_slot"]
    a = {r.doc_id: (r._shard, r._slot, r._size) for r in once.collect()}
    b = {r.doc_id: (r._shard, r._slot, r._size) for r in shard_documents(once, 4).collect()}
    assert a == b and len(a) == 30 and {s for s, _, _ in a.values()} == {0, 1, 2, 3}
