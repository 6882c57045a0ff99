"""Words of plain pieces, cut with arrays, against the pattern."""

import random

import pyarrow as pa
import pytest
import regex

from plangauge.llm import packing as P

MARKS = "'''''aSsTtrevmLld19²½.,!-\xad" + "".join(map(chr, (0xC9, 0xDF, 0x131, 0x149, 0x181, 0x1C5, 0x1F0, 0x23A, 0x23E, 0x24F, 0xAA, 0xD7)))
ALL = "".join(chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)])


@pytest.mark.parametrize("pieces", [[], [""], ["'s"], ["a'll", "'"], ["'l", "l", "'L"], ["'s's", "''t", "x'dy", "'rest"], [ALL, "", *ALL], None])
def test_words_are_those_of_the_pattern(pieces):
    r = random.Random(3)
    pieces = ["".join(r.choice(MARKS) for _ in range(r.randint(0, 9))) for _ in range(20000)] if pieces is None else pieces
    want = [regex.findall(P.PATTERN, x.lower()) for x in pieces]
    for column in (pa.array(pieces, pa.string()), pa.array(["x", *pieces], pa.string()).slice(1)):
        words, n = P.plain_words(column)
        assert n.tolist() == [len(x) for x in want]
        assert words.to_pylist() == [w for x in want for w in x]


def test_words_have_the_ids_that_the_library_gives():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(5)
    marks = ALL + " \t\n\v\f\r" + "'saSéÿŒß9 ½" * 9
    lines = ["", " ", ALL, " ".join(ALL), *("".join(r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(3000))]
    lines += ["\x85", "a\x7fb", "\x01", "x\xa0y", "İstanbul", "éa", "Б д", "日本", "<|x", "a<|endoftext|>b", "<|startoftext|>", "ɐ", "a" * 5000]
    r.shuffle(lines)
    library = Tokenizer.from_file(path)
    want = [library.encode(x, add_special_tokens=False).ids for x in lines]
    for column in (pa.array(lines), pa.array(["İ", *lines]).slice(1), pa.array(["é", "", "9"])):
        ids, n = P.token_ids(column, path)
        whole = [library.encode(x, add_special_tokens=False).ids for x in column.to_pylist()] if len(column) < 9 else want
        assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


def test_plain_texts_are_those_of_the_pattern():
    special = ["<|a|>", "<|b|>"]
    each = [*map(chr, range(0x300)), "é\x85", "’", "x<|a|>", "<|a", "\U0001f600", ""]
    got = P.plain_texts(pa.array(["z", *each]).slice(1), special)
    want = [regex.fullmatch(P.PLAIN.replace(r"\x{12f}", "į").replace(r"\x{24f}", "ɏ").replace(r"\x{a1}", "\xa1").replace(r"\x{131}", "ı"), x) is not None and "<|a|>" not in x for x in each]
    assert got.tolist() == want
    assert P.plain_texts(pa.array([], pa.string()), special).tolist() == [] and P.plain_texts(pa.array(["", ""]), []).tolist() == [True, True]


def test_a_worker_keeps_no_words():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    before = len(P._tokens(path).known.young)
    P.token_ids(pa.array([f"word{i} {chr(97 + i % 26) * (i % 40)}" for i in range(1000)]), path)
    assert len(P._tokens(path).known.young) == before
