import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm.token_count import Merger, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MERGER, LIBRARY = Merger(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@given(st.text(alphabet="ab \n\t\r▁é中😀<s></s>;{}x\x00 　the", max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_as_the_library(text):
    assert MERGER.count(text) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("text", ["<s>", "</s> <unk>", "<0x0A>", "   lead", "trail   ", "a" * 3000, "▁▁▁ x", "\n\n\n", "word " * 2000])
def test_special_strings_and_long_texts(text):
    assert MERGER.count(text) == len(LIBRARY.encode(text))


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr("sightline.llm.token_count.MEMO_CHUNKS", 50)
    rng, own = random.Random(3), Merger(MODEL)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(40))
        assert own.count(text) == len(LIBRARY.encode(text))
    assert len(own.memo) <= 50


def test_frame(odd, none):
    got = token_counts(odd, MODEL).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(LIBRARY.encode(r.text or ""))) for r in odd.collect()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert token_counts(none, MODEL).collect() == []
