"""Exact combinations behind many that fail."""

from turnlake.llm import packing


def test_all_heads_are_tried():
    # 1000 - 2y and y once each: y + y isn't there, and no other two of them add up to the rest.
    odd = [2 * s + 1 for s in (0, 1, 3, 4, 9, 10, 12, 13, 27, 28, 30, 31, 36, 37, 39, 40, 81)]
    counts = {n: 1 for n in [1048, 400, 350, 250, *odd, *(1000 - 2 * y for y in odd)]}
    patterns = [sorted(lengths) for lengths, _ in packing.plan(counts)]
    assert [250, 350, 400, 1048] in patterns and sorted(sum(patterns, [])) == sorted(counts)


def test_words_of_small_letters():
    """Words that go to the merges at once have the ids of the whole tokenizer, as have their neighbours in text."""
    import random
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder, r = Tokenizer.from_file(path), packing.ChunkEncoder(path), random.Random(7)
    assert encoder.direct
    letters = "abcdefghijklmnopqrstuvwxyzeeeettaaooßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    others = "A É 'S 's don't ª º µ × ÷ ĳ ſ ﬁ é ẍy 中文 9 a1 _ - ... İ Σ ς ά".split()
    for _ in range(3000):
        words = ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(4)] + r.choices(others, k=2)
        words += [words[0].upper(), words[1].title() + ",", words[2] + r.choice(others)]
        r.shuffle(words)
        ids = own.encode(" ".join(words), add_special_tokens=False).ids
        assert encoder.encode(" ".join(words)) == struct.pack(f"<{len(ids)}I", *ids), words
