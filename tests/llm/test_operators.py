import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import decontaminate, html_wrapper, line_dedup, multiset_hash, ngram_join, quality_qda, queries, sentencepiece_viterbi, shards, textkernel, warc
from gaugeworks.llm.chat import escape, unescape
from gaugeworks.llm.workspace import table
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


BASE = prose(1, 200)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(" ", "  ") + " more"), (4, None), (5, ""), (6, " \t\n"), (7, "two words"), (8, "TWO words"),
    (None, BASE + " tail"), (None, prose(2, 30)), (10, prose(3, 20000)), (11, "x" * 50000), (12, prose(4, 50)), (12, prose(5, 50)),
    (13, "a\nb\n" + "\n".join(prose(k, 12) for k in range(40, 60))), (14, "c\n" + "\n".join(prose(k, 12) for k in range(40, 60)) + "\nd"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if i % 3 else "en", "s", len(t or ""), i, f"c{i}") for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 int, row string")


def nothing(df):
    return df.where("false")


def shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return sorted(((k, len(s), least.get(top(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_jaccard_classes_match_all_pairs(spark, docs):
    edited = BASE.split()
    more = []
    for k in range(20, 60):  # chains of edited copies around the threshold
        edited = edited[:]
        edited[(k * 7) % 200] = f"edit{k}"
        more.append((k, " ".join(edited[: 200 - k])))
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = ngram_join.jaccard_classes(spark, frame)[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(TEXTS + more)
    assert ngram_join.jaccard_classes(spark, nothing(docs))[0].count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    got = sorted((r.doc_id, r.text) for r in ngram_join.without_near_copies(spark, docs).where("doc_id is not null").collect() if r.text is not None)
    assert [k for k, _ in got] == [1, 5, 6, 7, 10, 11, 12, 12, 13]
    assert ngram_join.without_near_copies(spark, docs).columns == docs.columns


def test_repeated_line_chunks_go_and_one_stays(spark, docs):
    out = {(r.doc_id, r.row): r for r in line_dedup.dedup_lines(spark, docs).collect()}
    assert len(out) == docs.count()
    first, second = out[13, "c15"], out[14, "c16"]
    assert first.removed_lines == 0 and first.text == TEXTS[15][1]
    assert second.removed_lines >= 10 and second.text.startswith("c\n") and second.text.endswith("d")
    lost = set(TEXTS[16][1].split("\n")) - set(second.text.split("\n"))
    assert lost <= set(TEXTS[15][1].split("\n"))
    assert out[4, "c4"].text is None and out[5, "c5"].text == "" and out[10, "c11"].text == TEXTS[11][1]
    assert line_dedup.dedup_lines(spark, nothing(docs)).count() == 0


def brute_line_dedup(texts):
    """Lines left of each text: what lies in a run that stands earlier too goes; a run has two lines and 40 bytes, or one line of 200, or more."""
    lines = [t.split("\n") for t in texts]
    seen = {}
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for z in range(a + 1, len(ls) + 1):
                seen.setdefault(tuple(ls[a:z]), (d, a))
    goes = {
        (d, i)
        for d, ls in enumerate(lines)
        for a in range(len(ls))
        for z in range(a + 1, len(ls) + 1)
        if len("\n".join(ls[a:z])) >= (40 if z > a + 1 else 200) and seen[tuple(ls[a:z])] < (d, a)
        for i in range(a, z)
    }
    return ["\n".join(x for i, x in enumerate(ls) if (d, i) not in goes) for d, ls in enumerate(lines)]


def test_line_dedup_takes_out_the_maximal_repeated_runs(spark):
    r, texts = random.Random(7), []
    for size in (2, 3, 4, 5, 8, 13, 20):  # shared passages, whole or a part, in different surroundings
        for words in (1, 3, 12):
            passage = [prose(r.randrange(10**6), words) for _ in range(size)]
            for k in range(3):
                lo = r.randrange(size - 1) if k == 2 else 0
                around = [[prose(r.randrange(10**6), 9) for _ in range(r.randrange(4))] for _ in range(2)]
                texts.append("\n".join(around[0] + passage[lo:] + around[1]))
    alone = (prose(40, 60) + " " * 200)[:200]  # the shortest line that is a run of its own
    for k, line in enumerate([alone, alone[1:], alone, prose(41, 60), prose(41, 60), alone[1:]]):
        texts.append("\n".join([prose(50 + k, 3), line, prose(60 + k, 1), "ab", prose(70 + k, 9)]))
    texts += [alone, "x\n" + alone, "ab\n" + alone + "\ncd", "\n".join([alone] * 3), "zz\nab\n" + alone + "\ncd"]
    texts += ["\n".join([prose(8, 9)] * 5), prose(8, 9) + "\nother", "\n" * 60, "x\n" + "\n" * 60, "short\nrun", "short\nrun", ""]
    out = line_dedup.dedup_lines(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {row.doc_id: row for row in out.collect()}
    want = brute_line_dedup(texts)
    assert [got[k].text for k in range(len(texts))] == want
    kept = [w.count("\n") + 1 if w or t == w else 0 for t, w in zip(texts, want)]
    assert [got[k].n_lines - got[k].removed_lines for k in range(len(texts)) if want[k]] == [n for n, w in zip(kept, want) if w]


def test_runs_of_one_digest_are_compared_byte_by_byte(spark):
    """Runs that only their digest takes for equal stay."""
    same, other = prose(31, 12) + "\n" + prose(32, 12), prose(33, 12) + "\n" + prose(34, 12)
    text = pa.array([same, other, same])
    everything = np.full(16, 2**64 - 1, np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), text], names=["k1", "k2", "text"])
    rows = pa.Table.from_batches(line_dedup._run_rows(everything)([batch])).to_pylist()
    assert [r["run"].decode() for r in rows] == [same, other, same]
    assert rows[0]["d1"] == rows[2]["d1"] != rows[1]["d1"]
    found = spark.createDataFrame([(1, 1, 0, 2, 5, 5, b"x"), (2, 2, 0, 2, 5, 5, b"y"), (3, 3, 0, 2, 6, 6, b"z"), (4, 4, 0, 2, 6, 6, b"z")], line_dedup._RUNS)
    assert [r.d1 for r in line_dedup.staying(found).collect()] == [6]


def test_leaks_are_the_same_in_slices(spark, docs, monkeypatch):
    items = [(k, prose(900 + k, 30)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100 + k, f"{prose(5 + k, 40)} {items[k][1]} {items[(k + 1) % 6][1]} {prose(60 + k, 40)}") for k in range(6)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = lambda: sorted(map(tuple, decontaminate.leaks(spark, more, bench).collect()))
    whole = found()
    assert len(whole) >= 12
    monkeypatch.setattr(decontaminate, "SLICE_GRAMS", 40)
    assert found() == whole


def test_chunk_boundaries_resist_shifts():
    lines = [prose(k, 8) for k in range(60)]
    chunks = lambda text: set(zip(*[x.tolist() for x in line_dedup.chunk_lines(pa.array([text]))[4:]]))
    a, b = chunks("\n".join(lines)), chunks("\n".join(["new"] + lines))
    assert len(a & b) >= len(a) - 2


PAGE = """<html><head><title>t</title><script>if (a<b) x()</script></head><body><div class="top">Site name &amp; motto</div>
<div id="c"><h2>{0}</h2><p>{1}<br>and <b>b</b>old &lt;{0}&gt;</p><p>Read more below</p><div class="comments">me too</div></div>
<aside>side</aside><!-- no --><p>All rights reserved here</p><form>f</form></body></html>"""


def test_constant_nodes_are_template_and_slots_content(spark):
    pages = [(k, f"http://h.example/{k}", PAGE.format(prose(k, 6), prose(k + 100, 40))) for k in range(12)]
    pages += [(50, None, None), (51, "http://h.example/x", ""), (52, "nohost", "<p>one<p>two  &eacute;<ul><li>a<li>b"), (0, *pages[0][1:])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", html_wrapper.F.lit(1))
    got = html_wrapper.main_text(spark, frame).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert text[3] == f"{prose(3, 6)} {prose(103, 40)} and bold <{prose(3, 6)}>"
    assert (text[50], text[51], text[52]) == ("", "", "one two é a b")
    assert html_wrapper.main_text(spark, nothing(frame)).count() == 0


def test_chrome_words_do_not_take_the_article():
    main, card, page = prose(1, 60), prose(2, 6), lambda html: " ".join(x.text for x in html_wrapper.slots(html_wrapper.dom(html)))
    for name in ("layout no-sidebar", "has-comments", "with-menu", "post-share"):
        assert page(f"<div class='{name}'><p>{main}</p></div>") == main
    assert page(f"<div class='search'><main><p>{main}</p></main></div><p>{card}</p>") == main
    assert page(f"<main><div class='sidebar'><article>{main}</article></div></main>") == main
    assert page(f"<article>{main}<article class='comment'>{card}</article></article><article class='ad'>{card}</article>") == main
    assert page(f"<article>{main}</article><div class='related'><article>{card}</article></div>") == main
    assert page(f"<nav><article>{card}</article></nav><p>{main}</p>") == main
    assert page(f"<div><p>{main}</p><article>{card}</article></div>") == f"{main} {card}"
    assert page(f"<form><nav>{card}</nav><article>{main}</article><p>{card}</p></form>") == main
    assert page(f"<article>{main}<form>{card}</form><p class='long-form'>{card}</p></article>") == f"{main} {card}"
    assert page(f"<html><head><title>t</title><style>x</style><body><article>{main}</article>") == main
    assert page(f"<head><meta charset=utf-8><script>{card}</script></head><div class='layout with-sidebar'><article>{main}</article></div>") == main


def test_hosts_beyond_the_broadcast_give_the_same_text(spark):
    pages = [(k, f"http://h{k % 3}/{k}", PAGE.format(prose(k, 6), prose(k + 100, 40))) for k in range(45)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    near = sorted((r.page_id, r.text) for r in html_wrapper.main_text(spark, frame).collect())
    old = html_wrapper.BROADCAST_BYTES
    try:
        html_wrapper.BROADCAST_BYTES = 0
        assert sorted((r.page_id, r.text) for r in html_wrapper.main_text(spark, frame).collect()) == near
    finally:
        html_wrapper.BROADCAST_BYTES = old


def test_copies_of_one_page_keep_their_text(spark):
    html = PAGE.format("Heading", prose(1, 40))
    frame = spark.createDataFrame([(k, "http://h/", html) for k in range(10)], "page_id long, url string, html string")
    assert {r.text for r in html_wrapper.main_text(spark, frame).collect()} == {
        f"Site name & motto Heading {prose(1, 40)} and bold <Heading> Read more below All rights reserved here"
    }


def test_tree_matching_maps_the_largest_common_structure():
    a, b = html_wrapper.dom("<div><p>x<ul><li>1<li>2</ul><h2>t</h2></div>"), html_wrapper.dom("<div><h1>n</h1><p>y<ul><li>2</ul><h2>t</h2></div>")
    place = {id(x): k for k, x in enumerate(html_wrapper.leaves(b))}
    same = html_wrapper.equal_leaves(a, b, place)
    assert {html_wrapper.leaves(a)[k].text for k in range(4) if id(html_wrapper.leaves(a)[k]) in same} >= {"t"}
    old = html_wrapper.CELLS
    m = html_wrapper.Matcher()
    xs = [m.shape(html_wrapper.Node(random.Random(k).choice("abc"))) for k in range(60)]
    ys = [m.shape(html_wrapper.Node(random.Random(k + 99).choice("abc"))) for k in range(50)]
    whole = m.pairs(xs, ys)
    try:
        html_wrapper.CELLS = 100
        assert len(m.pairs(xs, ys)) == len(whole)
    finally:
        html_wrapper.CELLS = old


def test_ids_are_those_of_the_library_and_decode_back(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    r = random.Random(3)
    odd = ["".join(r.choice(["a", "th", "ing", " ", "   ", "\n", "é", "中", "😀", "12", "...", "\t", "ß", "Ж"]) for _ in range(r.randrange(30))) for _ in range(800)]
    vocab = sentencepiece_viterbi.pieces(sentencepiece_viterbi.MODEL)
    texts = [t or "" for _, t in TEXTS] + odd
    ids, off = sentencepiece_viterbi.encode_column(pa.array(texts), vocab)
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == model.encode(t)
    out = sentencepiece_viterbi.decoded(sentencepiece_viterbi.encoded(docs.withColumn("ids", docs.k1))).collect()
    assert all(r.decoded == (r.text or "") for r in out) and len(out) == docs.count()
    mark = sentencepiece_viterbi.encode_column(pa.array(["a ▁ b"]), vocab)[0]
    assert sentencepiece_viterbi.decode_ids(mark.tolist(), vocab) == "a ▁ b"
    assert sentencepiece_viterbi.encoded(nothing(docs)).count() == 0
    other = sentencepiece_viterbi.encoded(docs.withColumnRenamed("k1", "IDS").withColumnRenamed("row", "N_Tokens"))
    assert other.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"] and other.where("text is null and n_tokens <> 0").count() == 0


def test_pieces_that_end_at_a_character_and_remembered_words(monkeypatch):
    vocab = sentencepiece_viterbi.Pieces(sentencepiece_viterbi.MODEL)
    r = random.Random(4)
    words = [" " + "".join(r.choice(["a", "th", "ing", "er", "\n", "é", "中", "12", "...", "ß", "tion"]) for _ in range(r.randrange(9))) for _ in range(300)]
    for steps in (0, 10**6):  # without room for further steps, and with it
        vocab.room = steps
        for word in words:
            at = vocab.root
            for i, c in enumerate(word, 1):
                at = at.get(c) or vocab._step(at, c)
                assert at[0] == tuple((n, vocab.ids[word[i - n : i]]) for n in range(i, 1, -1) if word[i - n : i] in vocab.ids)
    monkeypatch.setattr(sentencepiece_viterbi, "REMEMBERED", 50)
    asked, encode, words = [], vocab.encode_sorted, sorted({*words, " " + "long" * 20})
    monkeypatch.setattr(vocab, "encode_sorted", lambda new: asked.append(new) or encode(new))
    first = vocab.encode_words(words)
    # More than fit: the latest words are known all the same, but for the long one, and others are forgotten.
    assert vocab.encode_words(words) == first and asked[1] == [" " + "long" * 20]
    vocab.encode_words([" other", " words"])
    assert vocab.words.keys() == {" other", " words"}


def test_unigram_paths_have_the_best_score():
    vocab = sentencepiece_viterbi.Pieces(sentencepiece_viterbi.MODEL, merges=False)

    def best(word):
        score = [0.0]
        for i in range(1, len(word) + 1):
            arcs = [(score[j], word[j:i]) for j in range(i) if word[j:i] in vocab.ids or i - j == 1]
            score.append(max(s + vocab.score.get(p, vocab.unknown) for s, p in arcs))
        return score[-1]

    words = sorted({" thing", " things", " thinking", " other", " others", " x中y"})
    back = {k: t for t, k in vocab.ids.items()}
    for word, ids in zip(words, vocab.encode_sorted(words)):
        ids = memoryview(ids).cast("i").tolist()
        unknown = sum(c not in vocab.ids for c in word)
        if not unknown:
            assert sum(vocab.score[back[k]] for k in ids) == pytest.approx(best(word))


def test_quality_is_learnt_for_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = quality_qda.quality_scores(spark, docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) > 50
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_quality_with_nulls_and_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_qda.quality_scores(spark, docs, none).collect()} == {0.5}
    assert quality_qda.quality_scores(spark, nothing(docs), none).count() == 0
    assert quality_qda.accepted(spark, docs, none).count() == docs.count()
    assert quality_qda.accepted(spark, docs, none).columns == docs.columns


def peak_mb(make) -> float:
    """MB that are held at most while the rows of `make` are read."""
    tracemalloc.start()
    for _ in make:
        pass
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most / 1e6


def test_memory_of_a_task_follows_bytes_not_rows():
    # 200 texts of 5,000 words in one Arrow batch.
    text = pa.array([prose(k, 400) + f" {k} " + " ".join(WORDS * 200) + "\n" for k in range(200)])
    ids = pa.array(range(len(text)))
    one = pa.RecordBatch.from_arrays([ids, ids, text], names=["k1", "k2", "text"])
    assert peak_mb(quality_qda._statistics_rows([one.select(["k1", "text"])])) < 40
    assert peak_mb(line_dedup._hashes([one])) < 3
    assert peak_mb(decontaminate._stretches(np.array([3], np.uint64), [4], 10)([pa.RecordBatch.from_arrays([ids, ids, ids, text], names=list("abcd"))])) < 20
    at = list(textkernel.slices(text, 50))
    assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]] and sum(n for _, n in at) == 200
    assert max(len("".join(text.slice(a, n).to_pylist())) for a, n in at) <= 1 << 19
    assert list(textkernel.slices(pa.array([None, "x" * 9, "", "y"]), 2, 4)) == [(0, 1), (1, 1), (2, 2)]
    assert list(textkernel.slices(pa.array(["a"] * 5), 2)) == [(0, 2), (2, 2), (4, 1)]


def test_batches_between_spark_and_python_are_bounded(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    none = spark.createDataFrame([], "doc_id long, quality int")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    assert quality_qda.accepted(spark, rows, none).mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 5 << 20
    spark.conf.set(key, "2m")
    quality_qda.accepted(spark, rows, none)
    assert spark.conf.get(key) == "2m"
    spark.conf.unset(key)


def test_quality_sums_texts_in_one_pass_and_counts_repeated_labels(spark, docs, capsys):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (2, 1), (7, None), (7, 5), (None, 1), (12, 1), (99, 0)], "doc_id long, label int")
    sums = quality_qda.class_sums(docs.select("doc_id", "text"), labels)
    sums.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    stats = quality_qda.document_statistics(docs)
    by_label = stats.join(labels, "doc_id").select("label", "x").collect()
    for got in (sums, quality_qda.class_sums(stats, labels)):
        m = {(r.label, r.i, r.j): r.v for r in got.groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()}
        assert len(m) == 2 * 190
        for k in (0, 1):
            x = np.array([[1, *r.x] for r in by_label if r.label == k])
            assert m[k, 0, 0] == len(x) == (4 if k == 0 else 5)
            assert all(m[k, i, j] == pytest.approx(x[:, i] @ x[:, j]) for i in range(19) for j in range(i, 19))


def test_archives_split_anywhere_give_every_record_back(spark, tmp_path):
    pages = [(k, f"http://h/{k} ä", None if k == 3 else prose(k % 40, 3 * k)) for k in range(120)] + [(None, None, "null id"), (7, "again", prose(7, 21))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(frame.coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", "4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = warc.page_records(spark, path).collect()
            assert len(got) == len(pages)
            for r in got:
                body = dict((p[0], p[2] or "") for p in pages)[r.page_id].encode()
                assert r.payload_bytes == len(body) and r.payload_digest == warc.payload_digest(body)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    warc.write_warc(nothing(frame), str(tmp_path / "none"))


def test_damaged_archives_lose_the_damaged_records_only(spark, tmp_path):
    members = [warc.gzip_member(warc.record_bytes(k, f"http://h/{k}", prose(k, 400).encode(), None, "2000-01-01T00:00:00Z")) for k in range(12)]
    members[2] = members[2][: len(members[2]) // 2]
    members[5] = members[5][:200] + bytes(300) + members[5][500:]
    members[8] = warc.MAGIC + b"no gzip at all" + warc.MAGIC
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc").write_bytes(b"".join(members))
    (tmp_path / "d" / "b.warc").write_bytes(b"plain text " * 500)
    (tmp_path / "d" / "c.warc").write_bytes(members[-1][:-9])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("613", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = {r.page_id: r.payload_bytes for r in warc.page_records(spark, str(tmp_path / "d")).collect()}
            assert got == {k: len(prose(k, 400)) for k in range(12) if k not in (2, 5, 8)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_without_ids_balance(spark):
    rows = [(None, "same text " * 9)] * 2000 + [(5, "other text " * 9)] * 1000
    got = shards.sharded(spark, spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(got) == 8 and max(r.s for r in got) <= 1.25 * min(r.s for r in got)


def test_shards_are_even_and_slots_gapless(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = shards.sharded(spark, docs).collect()
    size = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(size) <= 1.02 * min(size)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_a_hot_text_alone_is_split(spark):
    rows = [(k, "hot text " * 20) for k in range(400)] + [(1000 + k, f"text {k % 60}") for k in range(120)]
    got = shards.sharded(spark, spark.createDataFrame(rows, "doc_id long, text string"), cells=8).collect()
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(b"hot text " * 20)
    assert len(got) == len(rows) and len(homes[hot]) == 8
    assert all(len(home) == 1 for crc, home in homes.items() if crc != hot)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_rows(spark, docs):
    rows = shards.sharded(spark, docs).collect()
    assert sorted(r.size for r in rows) == sorted(len(t or "") + 1 for _, t in TEXTS)
    assert all(r.text_crc32 == zlib.crc32(t.encode()) for r in rows for k, t in [(r.doc_id, dict(TEXTS)[r.doc_id] or "")] if r.doc_id not in (None, 12))
    assert shards.sharded(spark, nothing(docs)).count() == 0


def test_fingerprints_are_sums_over_paragraphs(spark, docs):
    rows = spark.createDataFrame([("a b.\nc", "c\na b.", "c", "a b.")], "x string, y string, c string, a string")
    x, y, c, a = rows.select(*[multiset_hash.vector(k) for k in ("x", "y", "c", "a")]).first()
    assert x == y and rows.select(multiset_hash.combine(multiset_hash.vector("x"), multiset_hash.vector("c"), -1)).first()[0] == a
    out = multiset_hash.document_fingerprints(spark, docs.where("doc_id is not null")).collect()
    order = [(1, BASE), (2, BASE), *TEXTS[3:9], *TEXTS[11:13]]
    by = {r.doc_id: r for r in out if r.doc_id != 12}
    for (k, t), (_, after) in zip(order, order[1:]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert by[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[k].n_chars == len(t)
    assert len(out) == 15 and by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1
    assert multiset_hash.document_fingerprints(spark, nothing(docs)).count() == 0


def test_leaks_of_copied_and_edited_items(spark, docs):
    item = prose(900, 30)
    words = item.split()
    edited = " ".join(words[:9] + ["changed"] + words[10:20] + words[21:])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, prose(901, 30)), (1, item)], "item_id long, text string")
    more = spark.createDataFrame([(100, f"{prose(5, 80)} {item.upper()}, {prose(6, 80)}"), (101, f"{prose(7, 300)}. {edited} {prose(8, 10)}")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark, docs.select("doc_id", "text").union(more), bench).collect()}
    assert set(got) == {(100, 1), (101, 1)}
    assert (got[100, 1].score, got[100, 1].start_word, got[100, 1].end_word) == (1.0, 80, 110)
    assert 0.8 < got[101, 1].score < 1
    assert decontaminate.decontaminated(spark, docs, bench).count() == docs.count()
    assert decontaminate.leaks(spark, nothing(docs), bench).count() == 0
    assert decontaminate.leaks(spark, docs, nothing(bench)).count() == 0


def test_control_strings_are_escaped_reversibly():
    for text in ("", "\\### Assistant: </turn> ok", "\\\\</turn>", "### User: ", "plain \\ text", "</role></turn>"):
        assert unescape(escape(text)) == text


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    clashing = "n_lines removed_lines doc rest cuts node th k k2 comp score predicted item_id keep s worded".split()
    docs = docs.select("*", *[F.lit(7).alias(c) for c in clashing])
    got = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = k == len(corpus_pipeline.STAGES) - 1
        out = stage(spark, got, SF)
        assert out.columns == ([*docs.columns, "ids", "n_tokens"] if last else docs.columns)
        assert stage(spark, nothing(docs), SF).count() == 0
        out.write.parquet(str(tmp_path / str(k)))
        got = spark.read.parquet(str(tmp_path / str(k)))
    kept = got.collect()
    assert sum(r.text == BASE for r in kept) == 1


def test_pipeline_drops_rejected_near_and_leaked_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.collect()}
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op4_quality_classifier"](spark, SF).collect()}
    assert ids and all(scores[k] == 1 for k in ids)
    leaked = {r.doc_id for r in decontaminate.leaks(spark, docs, table(spark, SF, "benchmark")).where("score = 1").collect()}
    assert not ids & leaked
    texts = {r.doc_id: r.text for r in out.collect()}
    assert {c for _, _, c in brute_components(sorted(texts.items()))} == ids
