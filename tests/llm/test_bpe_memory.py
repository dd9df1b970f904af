"""What an encoder holds between tasks."""

import pandas as pd

from inspectra.llm import bpe
from inspectra.llm.queries import word_bpe_path


def test_a_task_leaves_no_words_behind(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 50)
    known = bpe.encoder(word_bpe_path())
    texts = [" ".join(f"word{k} wörter{k % 7}" for k in range(a, a + 40)) for a in range(0, 400, 40)]
    rows = pd.DataFrame({"doc_id": range(10), "text": texts})
    parts = (rows.iloc[k : k + 1] for k in range(10))
    got = pd.concat(list(bpe.encoded_batches(parts, word_bpe_path())))
    assert set(known.known) == set(known.special) and not known.older and not known.apart
    again = bpe.Encoder(word_bpe_path())
    assert got["ids"].tolist() == [again.encode_batch([t])[0][0] for t in texts]


def test_a_task_that_stops_early_leaves_no_words_behind():
    known = bpe.encoder(word_bpe_path())
    part = bpe.encoded_batches(iter([pd.DataFrame({"doc_id": [1], "text": ["some words"]})]), word_bpe_path())
    next(part)
    assert "words" in known.known
    part.close()
    assert "words" not in known.known
