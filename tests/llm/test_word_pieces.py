import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronofold.llm.token_orc import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PATH)


def ids_of(encoder, texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    flat, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    return [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])]


def test_pieces_cut_at_words_give_the_ids_of_whole_texts(encoder):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["a", "Zed", "s", "t", "re", "ll", "'", "''", "’", "é", "ñandú", "×", "÷", "ß", "ª", "µ", "中文", "é", "0", "42", "²", "!", "?", ".", ",", "(", "<|", "|>", "_", "$$$", " ", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", "　", "🙂", "\x00", "\x7f"]
    for most in (4, 12, 60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, most))) for _ in range(3000)]
        assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_learnt_once_whatever_mark_or_line_follows(encoder):
    words = [a + b + c for a in ("ba", "né", "Tho") for b in ("li", "ñu", "xa", "re") for c in ("m", "ß", "nd")]
    marks = [".", ",", "!!", "$$$", "?\n", ":\n", ")", "%%%", "\n"]
    texts = [f"{w}{m}{v} {v}{m}" for w in words for v in words[::5] for m in marks]
    encoder.clear()
    library = Tokenizer.from_file(PATH)
    assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.known <= 2 * len(words) + 2 * len(marks)


def test_other_patterns_are_cut_at_spaces_only(tmp_path):
    from tokenizers import Regex, pre_tokenizers

    odd = Tokenizer.from_file(PATH)
    odd.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r" ?[^\s]+|\s+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    odd.save(file := str(tmp_path / "odd.json"))
    encoder = PieceEncoder(file)
    assert not encoder.words
    texts = ["the.end of,the day", "one;two three.four"]
    assert ids_of(encoder, texts) == [odd.encode(t, add_special_tokens=False).ids for t in texts]
