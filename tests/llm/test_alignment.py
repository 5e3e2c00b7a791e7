"""Cross-tokenizer alignment against a quadratic version over byte ranges."""

import hashlib
import random
from collections import Counter

import pytest

from conftest import SF_SMALL
from evalspark.llm.alignment import Aligner, Vocabulary, align

TOK = "/opt/tokenizers"
TEXTS = [
    None, "", " ", "   ", "a", "Hello, world! It's 12345 o'clock.", "tab\tand\nline\r\n\n  end  ", "ÀÉ ümläut ß — “quotes”", "日本語のテキスト 한국어",
    "🙂🙃 family 👩‍👩‍👧", "a ▁ literal low line", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x01 control", "x" * 500, "word " * 400,
    "word " * 400, " nbsp  thin", "don't we'll I'M", "é combining ‍ joiner", "﻿bom",
]


def sides(json=False):
    return Vocabulary.read(f"{TOK}/byte_bpe_50k.{'json' if json else 'tiktoken'}"), Vocabulary.read(f"{TOK}/piece_bpe_32k.model")


def brute(texts):
    """Rows by definition: libraries called directly, every token of one side against every token of the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOK}/piece_bpe_32k.model")
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in printable]
    decode = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def spans(pieces):
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        p = t.encode(" " + text, add_special_tokens=False).ids if text else []
        q = sp.encode(text) if text else []
        pa = [bytes(decode[c] for c in t.id_to_token(i)) for i in p]
        pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in q]
        if not text or b"".join(pa) != whole or b"".join(pb) != whole:
            docs.append(([], [], [], "", 0))
            continue
        sa, sb = spans(pa), spans(pb)
        links = [(p[i], q[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in sa} & {y[1] for y in sb})
        groups, lo = [], 0
        for hi in ends:
            ga = ",".join(str(i) for i, x in zip(p, sa) if lo < x[1] <= hi)
            gb = ",".join(str(j) for j, y in zip(q, sb) if lo < y[1] <= hi)
            groups.append(f"{ga}|{gb}")
            lo = hi
        docs.append((p, q, links, ";".join(groups), len(ends)))
    held = Counter(pair for d in docs for pair in set(d[2]))
    best = {}
    for (a, _), c in held.items():
        best[a] = max(best.get(a, 0), c)
    return [
        (len(p), len(q), n, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), g, hashlib.sha256(g.encode()).hexdigest() if p else "")
        for p, q, links, g, n in docs
    ]


def got(spark, texts, **how):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, chunk string, pair int")
    rows, links = align(docs, *sides(), **how)
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    return [tuple(r[c] for c in cols) for r in sorted(rows.collect(), key=lambda r: r.doc_id)], links


@pytest.mark.parametrize("chunk_bytes", [1, 1 << 20])
def test_equals_brute_force(spark, chunk_bytes):
    exp = brute(TEXTS)
    rows, links = got(spark, TEXTS, chunk_bytes=chunk_bytes)
    assert rows == exp
    assert exp[1] == (0, 0, 0, 0, 0, 0, "", "") and exp[10][0] == 0 and exp[5][0] > 0 and exp[11][0] > 0
    assert all(n_links == n_a + n_b - n for n_a, n_b, n, n_links, *_ in exp)  # slices are staircases
    per_a = {}
    for r in links.collect():
        per_a.setdefault(r.a, []).append(r)
    assert all((r["count"] == max(x["count"] for x in rs)) == r["best"] for rs in per_a.values() for r in rs)


def test_tables_texts(spark):
    import pyarrow.parquet as pq

    texts = sorted(pq.read_table(f"{SF_SMALL}/documents.parquet")["text"].to_pylist(), key=len)[:120]
    assert got(spark, texts)[0] == brute(texts)


def test_documents_are_aligned_in_batches(monkeypatch):
    """A task aligns many short documents at once, texts without tokens among them, with the rows and pairs of one at a time."""
    import pyarrow as pa

    from evalspark.llm import alignment

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    calls, align_some = [], Aligner.align
    monkeypatch.setattr(Aligner, "align", lambda self, x: calls.append(x) or align_some(self, x))
    monkeypatch.setattr(alignment, "TaskContext", Task)
    texts = [f"{t or ''} {k}" if k % 3 else t for k, t in enumerate(TEXTS * 20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    found, made = [], []
    for most in (1, 1 << 14, alignment.BATCH_BYTES):
        monkeypatch.setattr(alignment, "BATCH_BYTES", most)
        calls.clear()
        found.append([x.to_pylist() for x in alignment._chunks(Docs(), *sides(), True, 1 << 20)(iter([batch, batch]))])
        made.append(len(calls))
    assert found[0] == found[1] == found[2] and len(found[0][0][0]["rows"]) == 2 * len(texts)
    assert made[0] > made[1] > made[2] == 1


def test_chunks_are_written_as_small_rows(spark, monkeypatch):
    """Thousands of rows of a written table are in memory at once, so none has a whole chunk."""
    from evalspark.llm import alignment

    kept, keep = [], alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(alignment, "PIECE", 7)
    monkeypatch.setattr(alignment, "PIECE_BYTES", 300)
    assert got(spark, TEXTS)[0] == brute(TEXTS)
    rows = kept[0].collect()
    assert max(len(r[c]) for r in rows for c in ("pair", "docs", "at", "times")) <= 7
    assert max(sum(128 + len(x.groups) for x in r["rows"][:-1]) for r in rows) < 300
    assert len({r.chunk for r in rows}) < len(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    kind = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, None)], kind)
    rows = align(docs, *sides())[0].collect()
    assert sorted(r.n_a for r in rows) == [0, 2, 2, 2] and {r.count_sum for r in rows} == {0, 6}
    none, links = align(spark.createDataFrame([], kind), *sides())
    assert none.count() == 0 and links.count() == 0


def test_rank_file_gives_the_ids_of_the_json_file():
    rng = random.Random(3)
    json, ranks = (Aligner(sides(j)[0], sides()[1]) for j in (True, False))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 40_000):
        some = rng.sample(points[lo : lo + 40_000], 300)
        for c in map(chr, some):
            text = f"ab{c}cd{c}12{c}, {c} {c}'s  {c}{c}  x"
            assert list(json.sides[0][0](" " + text)) == list(ranks.sides[0][0](" " + text))
    assert json.sides[0][1][: len(ranks.sides[0][1])] == ranks.sides[0][1]


def test_unknown_tokenizer_file_is_refused(tmp_path):
    with pytest.raises(ValueError):
        Vocabulary.read(str(tmp_path / "x.bin"))
