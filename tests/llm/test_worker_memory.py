"""What Python workers keep from stage to stage."""

from palimpsest.llm import language_id, tokens, worker
from palimpsest.llm.queries import tokenizer_path


def test_a_worker_holds_one_operators_model():
    path = tokenizer_path("word_bpe_49k.json")
    tokens.ids_block(path, ["some words"])
    first = worker.kept("tokens")["tk", path]
    tokens.ids_block(path, ["more words"])
    assert worker.kept("tokens")["tk", path] is first
    language_id._model({"en": "some words"})
    assert list(worker._KEPT) == ["language_id"]
    worker.kept("near copies")
    assert worker._KEPT == {"near copies": {}}
