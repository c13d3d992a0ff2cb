"""The encoder's cache of chunks: what it holds, and that results don't depend on it."""

import random
import tracemalloc

import pyarrow as pa

from skyframe.llm import tokens
from skyframe.llm.tokens import Encoder, default_tokenizer, tokenizer_json

R = random.Random(8)


def texts(n):
    word = lambda: "".join(R.choices("abcdefghij", k=8))
    return pa.array([" ".join(word() for _ in range(500)) for _ in range(n)] + ["", None, "a  b", "x", "ä" * 40 + " " + "é" * 40])


def test_a_cached_chunk_takes_few_bytes():
    own, given = Encoder(tokenizer_json(default_tokenizer())), texts(100)
    own.encode(texts(1))
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    own.encode(given, 0)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * 50_000


def test_ids_are_the_tokenizer_s_whether_cached_or_not(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 700)
    monkeypatch.setattr(tokens, "CHUNKS", 64)
    own = Encoder(tokenizer_json(default_tokenizer()))
    for _ in range(2):
        given = texts(3)
        for _ in range(2):
            want = [x.ids for x in own.tokenizer.encode_batch(["" if t is None else t for t in given.to_pylist()], add_special_tokens=False)]
            assert own.encode(given).to_pylist() == want
            assert own.encode(given, 0).to_pylist() == [[*x, 0] for x in want]
            assert own.lengths(given).tolist() == [len(x) for x in want]


def test_the_token_step_gives_memory_back(monkeypatch):
    from skyframe.llm import token_output

    calls, rows = [], 50
    monkeypatch.setattr(token_output, "release_memory", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(rows)), "text": ["a b"] * rows, "chunk": [0] * rows, "row": list(range(rows))})
    held = type("Broadcast", (), {"value": tokenizer_json(default_tokenizer())})
    got = list(token_output._encoded(held)([batch, batch]))
    assert sum(b.num_rows for b in got) == 2 * rows and len(calls) >= 3
