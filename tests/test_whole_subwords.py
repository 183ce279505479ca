"""Subword tokenizers learn from every type, give texts back and can be kept."""

import time
from itertools import product

import pytest

from glyphmill.operators import codec, subword

TEXTS = ["the lower  lowest\nnew newest wide\t widest ", " leading", "", "a" * 300, "Ünïcode é — 漢字 🙂 end", "the low the low\n\n\nthe low", "don't 12,345 x<0x41>y [UNK] ##z"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")


@pytest.mark.parametrize("kind", ["bpe", "byte_bpe", "wordpiece", "unigram", "morpheme", "char_level"])
def test_round_trips(spark, docs, tmp_path, kind):
    c = codec.train(kind, docs, 600)
    path = f"file://{tmp_path}/{kind}"
    c.save(spark, path)
    kept = codec.Codec.load(spark, path)
    assert kept.kind == c.kind and kept.pieces == c.pieces and kept.merges == c.merges and kept.scores == pytest.approx(c.scores)
    coded = kept.encode(docs)
    got = {r.doc_id: r.text for r in kept.decoded(coded).collect()}
    want = {i: x.lower() if kind == "morpheme" else x for i, x in enumerate(TEXTS)} | {99: ""}
    assert got == want
    assert all(kept.decode(r.ids) == want[r.doc_id] for r in coded.collect())


@pytest.mark.parametrize("kind", ["byte_bpe", "unigram"])
def test_unseen_characters_are_bytes(docs, kind):
    c = codec.train(kind, docs, 400)
    for x in ("жук ☃", "\x00  ", "ÿ<0x00>"):
        assert c.decode(c.coder()(x)) == x


def test_words_and_specials(docs):
    c = codec.train("word_level", docs, 40)
    ids = [codec.vocab.BOS, *c.coder()("The low , QQQ ."), codec.vocab.EOS]
    assert ids[0] == 2 and 0 in ids and c.decode(ids) == "the low,"  # the texts have no full stop
    assert c.decode(ids, skip_special=False).startswith("[CLS] the low")
    assert c.tokens("the") == ["the"]
    with pytest.raises(ValueError, match="no tokenizer 'x'"):
        codec.train("x", docs, 10)


def _plain_merged(symbols, rank):
    s = list(symbols)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank]
        if not found:
            return s
        _, i = min(found)
        s[i : i + 2] = [s[i] + s[i + 1]]


def test_merged_against_the_definition():
    types = {"abab": 5, "aba": 4, "bcbc": 3, "aaaa": 2, "cab": 2, "abcabc": 1}
    _, merges = subword.learn_merges(types, 20)
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    for x in ("", "a", "aaaaaaa", "abcabcabab", "cabcabxaab", "bcbcbcaaab"):
        assert codec.merged(list(x), rank) == _plain_merged(x, rank)
    assert len(codec.merged(["a"] * 200_000, {("a", "a"): 0})) == 100_000


def test_every_type_is_learned_from(spark):
    """20,001 types, the last of which occurs once and alone has its characters."""
    rows = [(0, " ".join([f"a{i:05d}" for i in range(20_000)] * 2)), (1, "zzΩ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kind in ("bpe", "wordpiece"):
        c = codec.train(kind, docs, 60)
        assert 0 not in c.coder()("zzΩ")


@pytest.mark.parametrize(("kind", "size"), [("bpe", 100), ("byte_bpe", 290), ("wordpiece", 130)])
def test_merges_of_types_that_are_not_gathered(spark, monkeypatch, kind, size):
    """The same codec as learned from all types on the driver, which must not see them."""
    rows = [*enumerate(TEXTS), (50, "aaaa aaa aa a aaaaa éé ééé"), *((100 + i, f"w{i * 7919 % 1000} {'ab' * (i % 9)} {'##' * (i % 4)}x lower{i % 13}est") for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, all_types = subword.learn_merges, codec.train(kind, docs, size)
    monkeypatch.setattr(subword, "TYPES_ON_DRIVER", 60, raising=False)
    monkeypatch.setattr(subword, "REWRITE", 10, raising=False)
    monkeypatch.setattr(subword, "AHEAD", 12, raising=False)

    def few(types, *args, **more):
        assert len(types) <= 60, "all types are on the driver"
        return plain(types, *args, **more)

    monkeypatch.setattr(subword, "learn_merges", few)
    assert codec.train(kind, docs, size) == all_types
    assert len(all_types.pieces) == size


def test_few_types_of_many_characters_are_not_gathered(spark, monkeypatch):
    rows = [(i, "ab" * (3000 + i) + " ba" + "c" * (i % 3)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    all_types = codec.train("byte_bpe", docs, 275)
    monkeypatch.setattr(subword, "CHARS_ON_DRIVER", 10_000, raising=False)

    def none(*_, **__):
        raise AssertionError("all types are on the driver")

    monkeypatch.setattr(subword, "learn_merges", none)
    assert codec.train("byte_bpe", docs, 275) == all_types


def test_what_is_foretold_from_is_bounded(spark, monkeypatch):
    """Frequent types by themselves, and some of the rare ones for all of them; no task sends its own 20,000 types."""
    monkeypatch.setattr(subword, "TYPES_ON_DRIVER", 400)
    types = spark.createDataFrame([(f"w{i}", 500 if i < 10 else 1 + i % 3) for i in range(5000)] + [("x" * 5000, 900)], "token string, cnt long")
    words, weights = subword._foretold_from(types)
    assert {f"w{i}" for i in range(10)} <= set(words) and 100 < len(words) <= 400 and max(map(len, words)) < 10
    assert 0.7 < weights.sum() / (10 * 500 + 4990 * 2) < 1.3


@pytest.mark.parametrize("kind", ["bpe", "byte_bpe", "wordpiece", "unigram"])
def test_arrays_of_chunks_against_single_texts(spark, docs, kind):
    c = codec.train(kind, docs, 500)
    code = c.coder()
    assert {r.doc_id: r.ids for r in c.encode(docs).collect()} == {i: code(x) for i, x in enumerate(TEXTS)} | {99: []}
    few = subword.encode_chunks(docs, lambda: codec._BY_CHUNK[kind](c), most=1)  # forgets between batches
    assert {r.doc_id: r.ids for r in few.collect()} == {i: code(x) for i, x in enumerate(TEXTS)} | {99: []}
    n = len(c.pieces)
    lists = [[], None, [0, 1, n + 5, -3], list(range(n)), list(range(n - 1, 4, -1)), [n - 1, 200, 201]]  # byte pieces alone are no UTF-8
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    for skip in (True, False):
        assert {r.doc_id: r.text for r in c.decoded(rows, skip_special=skip).collect()} == {i: c.decode(x or [], skip) for i, x in enumerate(lists)}


def test_lexicon(spark):
    docs = spark.createDataFrame([(i, "Unhappy unhappy dogs") for i in range(5)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("unhappy", ["un", "happy"]), ("dogs", [])], "word string, morphemes array<string>")
    c = codec.train_morpheme(docs, 60, lexicon)
    assert c.tokens("Unhappy unhappy dogs") == ["un", "happy", " un", "happy", " dogs"]


def test_surfaces():
    assert codec.surfaces("The CAT", ["the", " cat"]) == ["The", " CAT"]
    assert codec.surfaces("The CAT", ["the", "cat"]) == ["the", "cat"]
    assert codec.surfaces("İx", ["i̇", "x"]) == ["i̇", "x"]


def test_segments_keep_to_boundaries():
    trie = subword.Trie({"ab": 0, "abc": 1, "c": 2, "bcd": 3})
    flags = [False, False, True, False, False, False, True]
    assert subword.segment_spans("abcdabc", flags, trie) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert subword.segment_spans("abcd", [], trie) == [(0, 3), (3, 4)]
    assert subword.segment_spans("abcd", [True, True], trie) == [(0, 1), (1, 4)]
    assert subword.segment_spans("", [True], trie) == []
    assert trie.prefixes("abcd", 0) == ["ab", "abc"] and trie.longest("xa", 0) is None


def test_word_pieces_of_few_lengths_are_tried():
    """Lengths that no piece of that beginning has are not tried: a long piece made each place of each chunk try them all."""
    long = "##" + "z" * 20_000
    c = codec.Codec("wordpiece", (*codec.SPECIALS, " a", "##a", "##aa", "##b#", long))
    ids = c.ids()
    began = time.monotonic()
    assert c.coder()("a" * 20_000) == [ids[" a"], *[ids["##aa"]] * 9_999, ids["##a"]]
    assert time.monotonic() - began < 2
    assert c.tokens("aaab# a##a " + "a" + "z" * 20_000) == [" a", "##aa", "##b#", codec.SPECIALS[codec.UNK], " a", long]


def test_short_chunks_merge_as_long_ones(monkeypatch):
    alphabet = ["a", "b", "c"]
    pairs = [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c"), ("a", "a"), ("abc", "a"), ("aa", "aa"), ("c", "ab")]
    rank = {p: i for i, p in enumerate(pairs)}
    words = ["".join(w) for n in range(8) for w in product(alphabet, repeat=n)]
    short = [codec.merged(list(w), rank) for w in words]
    monkeypatch.setattr(codec, "SHORT", -1)
    assert short == [codec.merged(list(w), rank) for w in words]
