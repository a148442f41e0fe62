"""The pipeline against its stages, worked out one by one."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: prose and junk, copies with and without edits, leaks, nulls, empty texts and repeated rows."""
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("aeiostrnl"), int(rng.integers(2, 9)))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    junk = lambda n: " ".join(f"#{'BUY!!' if rng.random() < 0.5 else '$$$'}{int(rng.integers(99))}" for _ in range(n))
    item = prose(40)
    rows = [(i, prose(int(rng.integers(30, 200))) if i % 5 else junk(60), f"s{i % 4}") for i in range(160)]
    rows += [(200 + i, rows[i][1], "s1") for i in range(10)] + [(220 + i, rows[20 + i][1] + " more", "s2") for i in range(10)]
    rows += [(240, prose(50) + " " + item + " " + prose(50), "s0"), (241, None, "s0"), (242, "", None), (243, " \n ", "s1"), (1, rows[1][1], "s1"), (None, prose(80), None)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "xx", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_and_run(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = [docs.collect()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        kept.append(docs.collect())
    start, good, single, clean, mixed = kept
    ids = lambda rows: {r["doc_id"] for r in rows}
    # Quality: junk and texts without words go, prose stays.
    assert not ids(good) & {241, 242, 243} and {i for i in range(160) if i % 5} <= ids(good) and len(ids(good) & set(range(0, 160, 5))) <= 2
    # Near duplicates: of every group of linked texts the least id stays.
    sets = {(r["doc_id"], r["text"]): shingles(r["text"]) for r in good if r["doc_id"] is not None}
    lost = {b[0] for a, x in sets.items() for b, y in sets.items() if a[0] < b[0] and 100 * len(x & y) >= 80 * len(x | y)}
    assert ids(good) - ids(single) == lost and {200 + i for i in range(10)} & ids(good) <= lost
    # Decontamination: the document around the item goes.
    assert ids(single) - ids(clean) == {240}
    # Mixing: no document more than three times, words by source near their targets.
    times = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert max(times.values()) <= 3 and ids(mixed) <= ids(clean)
    # Token files: the run's digest is that of the mixed documents, in the order of their ids.
    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    want = []
    for r in sorted(mixed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])):
        found = encode(r["text"], add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], want[-1][1] + want[-1][2] if want else 0, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == want


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
