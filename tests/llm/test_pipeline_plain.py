"""Every stage of the pipeline, and the whole of it, row by row against plain Python on documents with planted cases."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from palimpsest.llm import packing
from palimpsest.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(900)]
    body = lambda n: " ".join(r.choices(vocab, k=n))
    texts = [body(r.randint(8, 160)) for _ in range(90)]
    texts += [texts[3], texts[3], texts[4], "", None, "12 345 !", "   ", body(6000)]
    base = body(200).split()
    for k in (1, 2, 3, 20):  # near copies, the last too far off
        w = list(base)
        for p in r.sample(range(200), k):
            w[p] = f"new{k}x{p}"
        texts.append(" ".join(w))
    ids = r.sample(range(10_000), len(texts))
    langs, sources = ["en", "de", None], ["a", "b", "c", None, "d"]
    return [(i, t, langs[n % 3], sources[n * n % 5], len(t or ""), n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]


def plain_language(rows):
    return [x for x in rows if any(c.isalpha() for c in x[1] or "")]


def plain_exact(rows):
    best = {}
    for x in rows:
        best[x[1] or ""] = max(x, best.get(x[1] or "", x), key=lambda y: y[0])
    return list(best.values())


def plain_near(rows):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {x[0]: shingles(x[1] or "") for x in rows}
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if c == b else c for k, c in comp.items()}
    return [x for x in rows if comp[x[0]] == x[0]]


def plain_mix(rows):
    size = {x[0]: len((x[1] or "").split()) for x in rows}
    sources = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size[x[0]] for x in rows if x[3] == s) for s in sources}
    target, free, rest = {}, set(sources), sum(total.values())
    budget = rest
    while free:
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        for s in over or free:
            target[s] = 3 * total[s] if over else share[s]
            rest -= target[s]
        free -= over or set(free)
    copies = []
    for s in sources:
        queue = sorted((hashlib.md5(f"{x[0]}:mix".encode()).hexdigest(), x) for x in rows if x[3] == s)
        served = 0
        for epoch in range(3):
            for key, x in queue:
                served += size[x[0]]
                if size[x[0]]:
                    copies.append((served / target[s], key, x[0], epoch, x))
    out, words = [], 0
    for *_, x in sorted(copies, key=lambda c: c[:4]):
        words += size[x[0]]
        if words > budget:
            break
        out.append(x)
    return out


PLAIN = {"language_id": plain_language, "exact_dedup": plain_exact, "simhash": plain_near, "mixing": plain_mix}


def told(df):
    return Counter(tuple(x) for x in df.collect())


@pytest.mark.parametrize("name", list(PLAIN))
def test_stage(spark, rows, name):
    given = rows
    for before, f in PLAIN.items():
        if before == name:
            break
        given = f(given)
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = STAGES[name](spark, docs, "")
    assert got.columns == docs.columns and told(got) == Counter(PLAIN[name](given))
    assert STAGES[name](spark, docs.where("false"), "").count() == 0


def test_stages_leave_something_out(rows):
    given, counts = rows, [len(rows)]
    for f in PLAIN.values():
        given = f(given)
        counts.append(len(given))
    assert counts[0] > counts[1] > counts[2] > counts[3] and max(Counter(x[0] for x in given).values()) > 1


def plain_pieces(rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = Counter()
    for x in rows:
        ids = [*tk.encode(x[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            out[x[0], k, at, tuple(ids[at : at + 4096])] += 1
    return out


def test_run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    given = rows
    for f in PLAIN.values():
        given = f(given)
    assert Counter((x.doc_id, x.piece, x.start, tuple(x.ids)) for x in got) == plain_pieces(given)
    sequences = defaultdict(list)
    for x in got:
        assert len(x.ids) == x.length
        sequences[x.sequence_id].append((x.offset, x.length))
    for places in sequences.values():
        ends = [0]
        for offset, n in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 4096
    lengths = Counter(x.length for x in got)
    assert len(sequences) == packing.lower_bound(lengths, 4096)
