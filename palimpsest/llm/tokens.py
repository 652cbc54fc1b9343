"""Token counts and token pieces, with each distinct pre-token encoded once per block of documents.

A block is a part of an Arrow batch. Its distinct pre-tokens that are not yet known are encoded in one library call; counts (or
ids) are then joined to the block's per-document pre-token frequencies and summed. What is known is kept between
blocks up to a fixed number of entries, then cut back to the block at hand, so memory does not grow with the corpus
and nothing is shuffled. A global dictionary would shuffle every document's pre-tokens to save less work than that.

Defined cases: null text is empty; a text without tokens counts 0; rows are handled one by one, so repeats are equal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.worker import kept, slices

#: Pre-tokens kept from block to block, in each worker: this many new ones and as many older ones. Ids take more memory
#: than counts, so fewer are kept.
KNOWN, KNOWN_IDS = 200_000, 60_000
#: Documents of a block, for counts and for ids.
BLOCK, BLOCK_IDS = 1500, 500


class Known:
    """Pre-token to result, in two generations: what a full young generation did not ask for again is forgotten."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, used: set[str]) -> list[str]:
        """Pre-tokens to encode; older ones that are asked for again become young."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for p in used:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        return new


# --- counts with a sentencepiece model -------------------------------------------------------------------------------


def _pieces_model(path: str):
    state = kept("tokens")
    if ("sp", path) not in state:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        vocab = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # a break before a space, and around a line end, is safe only if no piece spans it
        if any("\n" in p or "▁" in p.lstrip("▁") for p in vocab):
            raise ValueError("this model has pieces that span the end of a pre-token")
        state["sp", path] = (sp, Known(KNOWN))
    return state["sp", path]


PRE_TOKEN = re.compile(" *[^ \n]+| +|\n")


def _count_block(path: str, texts: list[str]) -> list[int]:
    sp, known = _pieces_model(path)
    # the model marks a space and the start of a text by the same character
    bags = [Counter(PRE_TOKEN.findall(" " + t.replace("▁", " "))) if t else Counter() for t in texts]
    used = set().union(*bags)
    new = known.missing(used)
    # after a line end nothing is added in front: two pieces stand for the mark and the line end
    known.young.update(zip(new, (len(x) - 2 for x in sp.encode(["\n" + p for p in new], num_threads=1)), strict=True))
    return [sum(n * known.young[p] for p, n in bag.items()) for bag in bags]


def token_counts(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; model is a sentencepiece file that executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCK):
            counts = _count_block(model, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


# --- ids with a tokenizers file --------------------------------------------------------------------------------------


def _ids_model(path: str):
    """The tokenizer, its core, which of its ids end a word, and the known chunks."""
    state = kept("tokens")
    if ("tk", path) not in state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tk, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words that are normalised already: the same merges without the normalizer and the word pattern
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(tk.get_vocab_size(), bool)
        for piece, i in tk.get_vocab().items():
            ends[i] = piece.endswith("</w>")
        state["tk", path] = (tk, bare, ends, Known(KNOWN_IDS))
    return state["tk", path]


#: Characters at which str.split() breaks though the tokenizer's white space does not have them.
ODD = re.compile("[\x1c-\x1f]")
#: Texts whose lower case and word breaks need no library: Latin-1 letters, digits, blanks and ASCII marks without the
#: apostrophe, which may start a contraction. Their pre-tokens are runs of letters, single digits and runs of marks.
MARKS = re.escape('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
WORD = re.compile(f"(?:[a-zß-öø-ÿ]+|[0-9]|[{MARKS}]+)\\Z")
PRE_TOKENS = re.compile(f"[a-zß-öø-ÿ]+|[0-9]|[{MARKS}]+")
PLAIN = re.compile(f"[A-Za-z0-9À-ÖØ-öø-ÿ \n\t\r{MARKS}]*\\Z")
#: Where special tokens start, which are looked for before anything else.
SPECIAL = "<|"
SEPARATOR = "\x01"


def _chunks(text: str) -> list[str]:
    """Pieces of a text that encode on their own: the pre-tokens of a plain text, else of what is plain between blanks."""
    if PLAIN.match(text) and SPECIAL not in text:
        return PRE_TOKENS.findall(text.lower())
    if ODD.search(text):
        return []
    out: list[str] = []
    for c in text.split():
        if PLAIN.match(c) and SPECIAL not in c:
            out += PRE_TOKENS.findall(c.lower())
        else:
            out.append(c)
    return out


def _encode(tk, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tk.encode_batch_fast(texts, add_special_tokens=False)]


def _encode_chunks(tk, chunks: list[str], stop: np.ndarray, glue: str, own: int) -> list[bytes]:
    """Many chunks to a call; a chunk's ids run to the next id of `stop`, of which the last `own` are the glue's."""
    out: list[bytes] = []
    lines = [chunks[i : i + 256] for i in range(0, len(chunks), 256)]
    for part, e in ((x, y) for k in range(0, len(lines), 32) for x, y in zip(lines[k : k + 32], tk.encode_batch_fast([glue.join(x) + glue for x in lines[k : k + 32]], add_special_tokens=False), strict=True)):
        ids = np.array(e.ids, dtype="<u4")
        stops = (np.flatnonzero(stop[ids]) + 1) * 4
        if len(stops) == len(part):
            body, stops = ids.tobytes(), stops.tolist()
            out += [body[a : b - 4 * own] for a, b in zip([0, *stops], stops, strict=False)]
        else:
            out += _encode(tk, part)
    return out


def ids_block(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian uint32 ids of each text, for a tokenizer that drops white space and never joins across it."""
    tk, bare, ends, known = _ids_model(path)
    chunks = [_chunks(t) for t in texts]
    used = set().union(*chunks)
    new = known.missing(used)
    words = [c for c in new if WORD.match(c) and SPECIAL not in c]  # one pre-token each: its last id ends the word
    other = [c for c in new if not WORD.match(c) or SPECIAL in c]
    known.young.update(zip(words, _encode_chunks(bare, words, ends, " ", 0), strict=True))
    mark = np.zeros(len(ends), bool)
    mark[tk.encode(SEPARATOR, add_special_tokens=False).ids] = True
    known.young.update(zip(other, _encode_chunks(tk, other, mark, f" {SEPARATOR} ", 1), strict=True))
    at = known.young.__getitem__
    out = [b"".join(map(at, c)) for c in chunks]
    for i, t in enumerate(texts):
        if ODD.search(t):
            out[i] = _encode(tk, [t])[0]
    return out


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 4096, end: int = 1, ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut only where longer than limit."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCK_IDS):
            rows, ns, starts, lengths, crcs, bodies = [], [], [], [], [], []
            for r, body in enumerate(ids_block(tokenizer, [t or "" for t in b.column(1).to_pylist()])):
                body += tail
                for n, at in enumerate(range(0, len(body), 4 * limit)):
                    part = body[at : at + 4 * limit]
                    rows.append(r)
                    ns.append(n)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    bodies.append(part if ids else None)
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in bodies], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)
    return out.withColumnRenamed("id", id)
