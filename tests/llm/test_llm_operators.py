"""Each operator against a plain version, with nulls, empty and repeated rows, ties, extra columns and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, html_text, language_id, line_quality, mixing, packing, reply_trees, simhash, substring_dedup, tokens
from palimpsest.llm.labelled_pages import labelled_pages
from palimpsest.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, kept string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    body = lambda n: " ".join(r.choices(vocab, k=n))
    shared = body(50)
    out = [(i, body(r.randint(1, 120)) + ("\n" + shared + " " if i % 7 == 0 else ""), ["en", "de"][i % 2], f"s{i % 4}") for i in range(120)]
    long = body(400)
    words = long.split()
    for k in range(6):  # near copies
        w = list(words)
        w[17 * k] = "changed"
        out.append((200 + k, " ".join(w), "en", "s0"))
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, "  \n", "en", "s1"), (303, out[5][1], "en", "s2"), (303, out[5][1], "en", "s2"), (None, out[5][1], "en", None), (304, "Ünïcode 日本 ###", "de", "s3")]
    return out


def test_exact_copies_hot_and_other_groups(spark, monkeypatch):
    data = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"alone {i}", None, None) for i in range(120)]
    size = Counter(t for _, t, _, _ in data)
    top = {t: i for i, t, _, _ in data}
    want = sorted((i, top[t], size[t], i == top[t]) for i, t, _, _ in data)
    for parts in (1, 10, 10_000):  # no group, one group, every group is hot
        monkeypatch.setattr(exact_dedup, "HOT_PARTS", parts)
        assert sorted(tuple(r) for r in exact_dedup.exact_copies(make(spark, data)).collect()) == want


def test_exact_copies(spark, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = exact_dedup.exact_copies(make(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    left = exact_dedup.drop_copies(make(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "kept"] and left.count() == len(groups)
    assert exact_dedup.exact_copies(make(spark, rows).where("false")).count() == 0


def plain_print(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 1])
def test_simhash(spark, rows, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    fps = {(i, t): plain_print(t) for i, t, *_ in rows}
    nodes = sorted(set(fps.values()))
    comp = {x: x for x in nodes}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 2:
                comp[find(b)] = find(a)
    low = defaultdict(list)
    for (i, _), f in fps.items():
        if i is not None:
            low[find(f)].append(i)
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{fps[i, t]:016x}", min(low[find(fps[i, t])])) for i, t, *_ in rows)


def test_drop_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(300))
    near = long + " w0"
    other = "quite another text with words of its own"
    make_ids = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, _row string, _gone long")
    told = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r._row) for r in df.collect())
    assert (plain_print(long) ^ plain_print(near)).bit_count() <= 2
    plain = make_ids([(1, other, "a", 1), (2, long, "b", 1), (3, near, "c", 1), (4, None, "d", 1), (5, "", "e", 1)])
    left = simhash.drop_near_duplicates(plain)
    assert told(left) == [(1, "a"), (2, "b"), (4, "d")] and left.columns == plain.columns
    again = make_ids([(2, long, "a", 1), (3, near, "b", 1), (3, other, "c", 1), (2, long, "a", 1), (None, long, "d", 1), (None, "alone in the table", "e", 1)])
    left = simhash.drop_near_duplicates(again)
    assert told(left) == [(-1, "e"), (2, "a"), (3, "c")] and left.columns == again.columns
    assert simhash.drop_near_duplicates(plain.where("false")).count() == 0
    assert simhash.near_duplicates(plain.where("false")).count() == 0


def test_empty_tables(spark):
    none = make(spark, []).where("false")
    assert substring_dedup.duplicate_spans(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert language_id.keep_identified(none).count() == 0 and line_quality.cleaned(none).count() == 0
    assert mixing.mixed(none).count() == 0 and packing.packed(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert tokens.token_counts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_thresholds_are_allocated_by_cost():
    assert simhash.allocate([[0, 9, 9], [0, 1, 2], [0, 1, 9]], 0) == (3.0, [-1, 1, 0]) or simhash.allocate([[0, 9, 9], [0, 1, 2], [0, 1, 9]], 0)[0] == 3


def test_substring_dedup_of_a_passage_in_most_documents(spark):
    r, size = random.Random(5), 35
    body = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    common, twice, copy = body(60), body(40), body(90)
    docs = [body(r.randint(0, 50)) + (common[r.randint(0, 20) :] if i % 3 else []) + body(r.randint(0, 30)) for i in range(240)]
    docs += [copy] * 60 + [body(9) + twice, twice + body(4), ["again"] * 80]
    seen = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    want = {}
    for n, w in enumerate(docs):
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        want[n] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    table = make(spark, [(n, " ".join(w), None, None) for n, w in enumerate(docs)])
    for parts in (1, 40):  # all in one batch, or a few in each
        got = substring_dedup.duplicate_spans(table.repartition(parts)).collect()
        assert len(got) == len(docs) and {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in got} == want


def test_rows_known_to_repeat_are_marked():
    keys = np.array([5] * 9 + [6] * 7 + [7] * 8 + [8])
    take, h, other = substring_dedup.marked(np.arange(25), keys, np.zeros(25, int))
    assert all(o == -1 if k not in (5, 7) else o != i and keys[o] == k for i, (o, k) in enumerate(zip(other[:25], keys, strict=True)))
    assert take[:25].tolist() == list(range(25)) and sorted(keys[take[25:]].tolist()) == [5, 7]
    assert [x < 0 for x in h[:25]] == [k in (5, 7) for k in keys] and (h[25:] >= 0).all()
    assert len(substring_dedup.marked(np.arange(0), np.arange(0))[0]) == 0


def test_substring_dedup(spark, rows):
    size = 35
    words = [(t or "").split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    want = Counter()
    for (i, *_), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - size + 1) if seen[tuple(w[s : s + size])] > 1 for p in range(s, s + size)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    plain = make(spark, rows).withColumn("text", F.translate("text", "　", " "))
    got = substring_dedup.duplicate_spans(plain).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert any(r.n_removed for r in got)


def test_long_documents_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 64)
    w = [str(i % 91).encode() for i in range(1000)]
    whole = substring_dedup._anchors(w, 35)
    assert sorted(substring_dedup.anchors_of(w, 35).tolist()) == sorted(whole[0][np.unique(whole[1])].tolist())
    assert len(substring_dedup.phrases_of(w, 35, np.unique(whole[0]))[0]) == 966


def test_language_id(spark):
    r = random.Random(5)
    kinds = {"aa": "abcdefg ", "zz": "tuvwxyz "}
    rows = [(i, "".join(r.choices(kinds[k], k=300)), k, "s") for i in range(80) for k in [("aa", "zz")[i % 2]]] + [(900, None, "aa", "s"), (901, "123 !", "aa", "s"), (902, "", None, "s")]
    df = make(spark, rows)
    texts = language_id.training_text(df)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predicted(df, texts).collect()}
    assert all(got[i][0] == k for i, _, k, _ in rows[:80])
    assert {got[i] for i in (900, 901, 902)} == {("und", 0.0)}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.keep_identified(df).count() == 80
    held = {x.doc_id: x.h for x in df.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert not language_id.training_text(df.where("false"))


def test_cross_parse_is_greedy_longest_match():
    train = "the cat sat on the mat"
    p = language_id.CrossParser({"x": train})
    text = p.symbols("cat on that mat sat")
    sub = p.symbols(train).tobytes()
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1].tobytes() in sub:
            k += 1
        n, at = n + 1, at + k
    assert p.phrases([text])[0, 0] == n


def test_mix(spark, rows):
    got = mixing.fair_mix(make(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    per = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        per[r.source] += r.taken
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(per[s] - target[s]) <= 500 for s in target)
    again = mixing.fair_mix(make(spark, rows[::-1])).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.fair_mix(make(spark, rows).where("false")).count() == 0


def test_token_counts_and_ids(spark, rows):
    import sentencepiece
    from tokenizers import Tokenizer

    more = [*rows, (400, "  a  \n b <s> </s> ▁x\t\x00", "en", "s"), (401, "it's We'LL a<|endoftext|>b x\x1cy İ １２½ ...", "en", "s")]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = tokens.token_counts(make(spark, more), tokenizer_path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in more)
    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = tokens.pieces(make(spark, more), tokenizer_path("word_bpe_49k.json"), limit=64).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.start)):
        assert len(r.ids) == r.length <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        ids[r.doc_id].append((r.start, r.ids))
    for i, t, *_ in more:
        if i is not None and i != 303:
            assert sum((x for _, x in sorted(ids[i])), []) == [*tk.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, 0, r.choice([4096, 4000, 2048, 96, 1, r.randint(1, 900)])) for i in range(500)], "doc_id long, piece int, length long")
    got = packing.placed(df).collect()
    assert len(got) == 500
    seqs = defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(seqs) <= -(-sum(x.length for x in got) // 4096) + 2
    assert packing.placed(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.plan({5000: 1}, 4096)
    assert sum(n for _, n in packing.plan({6: 2, 5: 2, 4: 2, 3: 2, 2: 2}, 10)) == 4


def test_line_quality(spark, rows):
    text = "Home | News | Sport | More | Help\nA clean line of prose that ends here.\n### *** $$$"
    got = {r.doc_id: r for r in line_quality.cleaned(make(spark, [*rows, (500, text, "en", "s")])).collect()}
    assert got[500].clean_text == "A clean line of prose that ends here."
    assert got[300].n_words == 0 and got[300].base_failed and not got[300].kept
    for i, t, *_ in rows:
        w = (t or "").split()
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        twice = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(twice), len("".join(w)))


def test_reply_trees(spark):
    nodes = spark.createDataFrame(
        [("c", 1, None, "user", "hi", 1.0), ("c", 2, 1, "assistant", "a", 1.0), ("c", 3, 1, "assistant", "b<\\\"", 5.0), ("c", 4, 3, "user", None, 0.0), ("d", 7, 8, "user", "loop", 1.0), ("d", 8, 7, "user", "loop", 1.0), ("e", 1, 99, "user", "orphan", None)],
        "conv string, node long, parent long, role string, text string, score double",
    )
    full = nodes.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    got = {r.conv: r for r in reply_trees.read_back(reply_trees.formatted(full, reply_trees.paths(nodes))).collect()}
    assert [tuple(t) for t in got["c"].turns] == [("user", "hi"), ("assistant", "b<\\\""), ("user", "")]
    assert got["c"].loss_text == "b<\\\"" and set(got) == {"c", "e"}
    assert reply_trees.paths(nodes, top=2).select("leaf").distinct().count() == 3
    deep = spark.range(1, 41).select(F.lit("x").alias("conv"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    assert sorted((r.depth, r.node) for r in reply_trees.paths(deep).collect()) == [(i, i + 1) for i in range(40)]


def test_html_text(spark):
    model = html_text.trained()
    right = n = 0
    for page, content in labelled_pages(60, seed=77):
        nodes = html_text.parse(page)
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            if node.tag == "#" and node.text.strip():
                right, n = right + ((node.text.strip() in content) == (p > 0.5)), n + 1
    assert right / n > 0.97
    page = "<nav><a href=/>Menu</a></nav><article><h1>One &amp; two</h1><p>Some text here,\n that is <b>bo</b>ld.<script>x()</script></article><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (3, "")], "page_id long, html string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extracted(rows).collect())
    want = "One & two Some text here, that is bold."
    assert got == Counter([(1, want, len(want)), (2, "", 0), (3, "", 0), (3, "", 0)])


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from palimpsest.llm import oracle, queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    told = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in oracle.SQL.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(tuple(told(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(told, r)) for r in cur.fetchall()), name


def test_small_batches_keep_lower_settings(spark):
    from palimpsest.llm.worker import BATCH_ROWS, small_batches

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        small_batches(spark)
        assert (spark.conf.get(rows), spark.conf.get(size)) == (str(BATCH_ROWS), "16m")
        spark.conf.set(rows, "100")
        spark.conf.set(size, "1m")
        small_batches(spark)
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("100", "1m")
    finally:
        spark.conf.unset(rows)
        spark.conf.unset(size)
