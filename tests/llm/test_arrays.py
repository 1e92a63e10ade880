"""Numpy helpers against plain Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphsets.llm import codes, decontam, jaccard, langid, records, toxicity


def plain_words(text):
    out, word = [], ""
    for sign in [*text, " "]:
        if sign.isalpha() or sign.isdigit():
            word += sign.lower() if len(sign.lower()) == 1 else sign
        elif word:
            out.append(word)
            word = ""
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é ßİ1.\n𝔘z", max_size=30), max_size=6))
def test_words_and_windows(texts):
    text, hashes = codes.words(*codes.flatten(texts))
    expected = [(n, w) for n, t in enumerate(texts) for w in plain_words(t)]
    assert text.tolist() == [n for n, _ in expected]
    by_word = {}
    for (_, word), value in zip(expected, hashes.tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)
    where, first, found = codes.windows(text, hashes, 3)
    plain = []
    for n, t in enumerate(texts):
        w = plain_words(t)
        plain += [(n, tuple(w[k : k + 3])) for k in range(len(w) - 2)] or ([(n, tuple(w))] if w else [])
    assert where.tolist() == [n for n, _ in plain]
    seen = {}
    for (_, window), value in zip(plain, found.tolist(), strict=True):
        assert seen.setdefault(window, value) == value
    assert len(set(seen.values())) == len(seen)
    assert (np.diff(first) >= 0).all()


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 * (crc & 1))
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    assert int(records.crc32c(np.zeros(16, np.uint16), np.array([16]))[0]) == 0x8A9136AA  # 32 zero bytes
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 0, 3, 253, 254, 255, 256, 257, 1400, 0, 5])
    units = rng.integers(0, 1 << 16, lengths.sum(), dtype=np.uint16)
    cuts = np.cumsum(lengths)
    expected = [slow_crc32c(units[e - n : e].tobytes()) for n, e in zip(lengths, cuts, strict=True)]
    assert records.crc32c(units, lengths).tolist() == expected


def test_frames_round_trip_and_damage():
    parts = [np.arange(n, dtype=np.uint16) * 7 for n in (1, 300, 1, 65)]
    raw, sizes = records.frame(np.concatenate(parts), np.array([len(p) for p in parts]))
    entries = np.zeros(len(parts), records.ENTRY)
    entries["length"] = sizes
    assert [p.tolist() for p in records.unframe(raw, entries)] == [p.tolist() for p in parts]
    assert int.from_bytes(raw[:8], "little") == 2 and len(raw) == sizes.sum()
    mask = lambda crc: ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert int.from_bytes(raw[8:12], "little") == mask(slow_crc32c(raw[:8]))
    assert int.from_bytes(raw[14:18], "little") == mask(slow_crc32c(raw[12:14]))
    for at in (0, 9, 13, 40, len(raw) - 1):
        broken = bytearray(raw)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken), entries)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = records.session_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = [
        "", " ", "Plain words, and 12 numbers 3.5!", "It's we'll don't x's I'D", "a\x1cb", "Élan ÉLAN naïve Ǆ", "tab\tnew\nline\r\x0b\x0c\x85\xa0z",
        "<|endoftext|> a<|startoftext|>b", "no\x00nul \x7f del", "combining é x́", "日本語 テキスト", "ΑΣ ΣΑΣ", "a_b-c %%% $$$ x=1",
        "word " * 3000, "y" * 5000, "  sep 　 wide",
    ]
    ours = records.Encoder(path)
    assert ours.latin and ours.dtype == np.dtype("<u2")
    for text in texts * 2:
        expected = [*whole.encode(text, add_special_tokens=False).ids, records.END_ID]
        assert np.frombuffer(ours.encode(text), ours.dtype).tolist() == expected, repr(text[:40])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in [*range(1, 0x180), 0x300, 0x301, 0x327, 0x2019, 0x3A3, 0x212A]], max_size=12))
def test_encoder_on_any_latin_text(text):
    ours = records.encoder(records.session_tokenizer())
    assert ours.encode(text) == ours._whole(text) + ours._bytes([records.END_ID])


def test_cached_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(records, "CACHED_WORDS", 3)
    ours = records.Encoder(records.session_tokenizer())
    text = "one two three four five six one"
    assert ours.encode(text) == ours._whole(text) + ours._bytes([1]) and len(ours.words) <= 3


def test_spellings_of_a_word_are_encoded_once(monkeypatch):
    ours = records.Encoder(records.session_tokenizer())
    seen = []
    encode = ours.words.encode
    monkeypatch.setattr(ours.words, "encode", lambda word: seen.append(word) or encode(word))
    text = "\n".join(f"qua{a}x Qua{a}x, QUA{a}X\u201d qua{a}x's." for a in "abcdefghij") + "\nΣ one\n"
    assert ours.encode(text) == ours._whole(text) + ours._bytes([1])
    assert len(seen) == len(set(seen)) < 30, seen  # ten words, a few signs, one line with another letter


def test_words_met_again_stay_when_the_bound_is_reached(monkeypatch):
    monkeypatch.setattr(records, "CACHED_WORDS", 20)
    ours = records.Encoder(records.session_tokenizer())
    seen = []
    encode = ours.words.encode
    monkeypatch.setattr(ours.words, "encode", lambda word: seen.append(word) or encode(word))
    text = " ".join(f"the q{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    assert ours.encode(text) == ours._whole(text) + ours._bytes([1])
    assert seen.count("the") == 1 and len(ours.words) + len(ours.words.before) <= 20


def test_encoder_on_every_sign_it_cuts_by_rule():
    ours = records.encoder(records.session_tokenizer())
    for c in map(chr, range(0x2100)):
        text = f"a{c}b {c} x{c}'s{c}{c}7{c}, Don{c}t\nÉ{c}É"
        assert ours.encode(text) == ours._whole(text) + ours._bytes([1]), hex(ord(c))


def plain_phrases(text, sample):
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


def test_cross_parsing(monkeypatch):
    rng = random.Random(3)
    samples = {k: "".join(rng.choice(v) for _ in range(400)) for k, v in {"x": "aabc ", "y": "bccd "}.items()}
    model = langid.Model.fit({k: [v] for k, v in samples.items()})
    simple = {k: "".join(map(chr, langid.simplify([v])[0])) for k, v in samples.items()}
    texts = ["".join(rng.choice("abcdz ") for _ in range(n)) for n in (0, 1, 7, 200, 400, 512, 513, 1700)]
    points, lengths = langid.simplify(texts)
    got = model.phrases(model.symbols(points), lengths)
    for text, row in zip(texts, got.tolist(), strict=True):
        clean = "".join(map(chr, langid.simplify([text])[0]))
        cut = [clean[i : i + langid.SEGMENT] for i in range(0, len(clean), langid.SEGMENT)]  # a phrase ends at each seam
        assert row == [sum(plain_phrases(x, simple[k]) for x in cut) for k in model.languages]


def test_letters_of_all_planes():
    model = langid.Model.fit({"aa": ["plain letters"], "bb": ["others"]})
    assert model.predict([chr(0x30000) * 4])[0] != ["und"] and model.predict([chr(0xF0000) * 4])[0] == ["und"]
    kind, _, _ = codes.tables()
    assert all((kind[p] == codes.LETTER) == chr(p).isalpha() for p in range(0, codes.LIMIT, 7))


def test_large_alphabets_share_symbols():
    rng = random.Random(4)
    wide = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    model = langid.Model.fit({"zz": [wide], "yy": ["plain words of a small alphabet " * 50]})
    assert model.shared and model.steps.shape[1] <= langid.LETTERS + langid.CLASSES + 2
    assert model.predict([wide[:300], "small plain words", ""])[0] == ["zz", "yy", "und"]


def test_bayes_rule():
    least = jaccard.least_matches(0.8, 1e-9)
    assert least[128] < 0.8 * 128 and (np.diff(least) >= 0).all() and least[16] < 8
    sets = [np.unique(codes.mix(np.arange(k, k + 1000, dtype=np.uint64))) for k in (1, 101)]  # similarity 900 / 1100
    values = jaccard.minhash(sets)
    assert abs((values[0] == values[1]).mean() - 900 / 1100) < 0.12
    same = jaccard.minhash([sets[0], sets[0]])
    assert (same[0] == same[1]).all()


@pytest.mark.parametrize(
    "item, document, kind",
    [
        ("A farmer sold 12 apples to Anna for 3 dollars each and kept 5 apples for her sister", None, "verbatim"),
        (
            "A farmer sold 12 apples to Anna for 3 dollars each and kept 5 apples for her sister",
            "Intro text. A farmer sold 40 apples to Boris Smith for 7 euros each and kept 9 apples for her sister, so.",
            "reparameterised",
        ),
        (
            "The train needs 12 hours for the first part and 12 hours for the second and 12 hours home with 12 stops",
            "The train needs 12 hours for the first part and 13 hours for the second and 14 hours home with 15 stops",
            None,
        ),
        ("A farmer sold 12 apples to Anna for 3 dollars each and kept 5 apples", "A baker bought 12 pears from Anna at 3 dollars and ate 5", None),
        ("yes", "yes he said", None),
        ("one short item", "one short item", "verbatim"),
        ("小明有十二个苹果，给了小红五个，还剩几个？", "前面的文字。小明有十二个苹果，给了小红五个，还剩几个？后面的文字。", "verbatim"),
        ("小明有十二个苹果，给了小红五个，还剩几个？", "小明有十二个苹果给了小红五个还剩几个", "verbatim"),
        ("小明有十二个苹果，给了小红五个，还剩几个？", "今天天气很好，我们一起去公园散步，看见了很多花。", None),
        ("", "", None),
    ],
)
def test_templates(item, document, kind):
    found = decontam.Index([7], [item]).search([document if document is not None else f"Before. {item}. After", ""], 0.8, 0.8)
    assert len(found) == (kind is not None)
    if kind:
        assert ("verbatim" if found[0][5] == found[0][3] else "reparameterised") == kind


def test_names_that_open_sentences():
    searcher = decontam.Searcher([7, 8], [
        "Natalia sold 48 clips in April. Natalia sold half as many clips in May. How many clips did Natalia sell?",
        "Weng earns 12 dollars an hour for babysitting. Yesterday she did 50 minutes of it. How much did she earn?",
    ])
    texts = [
        "Maria sold 30 clips in June. Maria sold half as many clips in July. How many clips did Maria sell?",
        "Some words. Boris Lee earns 9 dollars an hour for babysitting. Today she did 20 minutes of it. How much did she earn?",
        "Maria bought 30 pens in June. Maria lost half of these pens in July. How many pens are left?",
    ]
    found = searcher.search(texts, 0.8, 0.8)
    assert [f[:2] for f in found] == [(0, 0), (1, 1)] and all(f[6] < f[4] for f in found)
    whole = decontam.Searcher([9], ["Boris Smith sold 12 old clocks. Boris Smith kept 5 clocks for 3 more weeks."])
    assert whole.search(["Anna sold 90 old clocks. Anna kept 7 clocks for 4 more weeks."], 0.8, 0.8)


def test_values_that_coincide():
    index = decontam.Index([7], ["A farmer sold 12 apples to Anna for 3 dollars each and kept 5 apples for her sister"])
    texts = [
        "A farmer sold 99 apples to Zoe for 4 euros each and kept 4 apples for her sister",
        "A farmer sold 4 apples to Zoe for 4 euros each and kept 4 apples for her sister",
    ]
    assert [(f[0], f[3], f[4]) for f in index.search(texts, 0.8, 0.8)] == [(0, 5, 5), (1, 5, 5)]
    again = decontam.Index([8], ["the train needs 12 hours to the coast and then 12 hours back to the old town"])
    assert not again.search(["the train needs 9 hours to the coast and then 7 hours back to the old town"], 0.8, 0.8)


def test_near_copies_of_short_items():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    around = " ".join(word() for _ in range(30))
    for size in (5, 6, 7, 8, 9, 10, 12, 15, 20, 29, 59):
        item = [word() for _ in range(size)]
        searcher = decontam.Searcher([1], [" ".join(item)])
        found = lambda words: bool(searcher.search([f"{around} {' '.join(words)} {around}"], 0.8, 0.8))
        differ = size // 5
        for _ in range(10):
            changed = rng.sample(range(size), differ + 1)
            assert found([word() if k in changed[:differ] else w for k, w in enumerate(item)]), size
            assert not found([word() if k in changed else w for k, w in enumerate(item)]), size
        if size >= 10:
            assert found([*item[: size // 2], word(), *item[size // 2 :]])
        assert not found(item[: size // 2])
    numbers = decontam.Searcher([1], ["12 45 78 11 99 23 54"])
    assert not numbers.search(["12 45 78 5 6 7 8"], 0.8, 0.8)


def test_items_of_few_words_as_sentences():
    searcher = decontam.Searcher([1, 2, 3], ["one short item", "Is it? No.", "12 45"])
    texts = ["Before. One short item! After", "Before\nis it? no\nAfter", "A line\n12 45\nand one short item more", "is it no more", "so: 12 46."]
    assert [f[:2] for f in searcher.search(texts, 0.8, 0.8)] == [(0, 0), (1, 1), (2, 2)]


def test_name_runs_do_not_change_other_words():
    index = decontam.Index([1], ["the old house near the river was sold by its owner last summer"])
    texts = ["we met Anna Maria Berg and Carl there", "x " * 50 + "the old house near the river was sold by its owner last summer"]
    assert [f[0] for f in index.search(texts, 0.8, 0.8)] == [1]


def test_lines_of_numbers_need_equal_numbers():
    index = decontam.Index([1], ["12 45 78 11 99 23 54"])
    assert index.search(["12 45 78 11 99 23 54"], 0.8, 0.8)
    assert not index.search(["1 2 3 4 5 6 7 8 9"], 0.8, 0.8)


def test_restored_words():
    corpus = ["the idiot and the clown went home with a stupid loser who was not pathetic at all"] * 30
    model = toxicity.language_model(toxicity.gram_counts(corpus))
    for written, meant in {"1d10t": "idiot", "cl0wn": "clown", "l-o-s-e-r": "loser", "stuuuupid": "stupid", "p@thet1c": "pathetic"}.items():
        assert toxicity.restore(written, model) == meant
    reader = toxicity.Reader(model)
    plain = codes.words(*codes.flatten(["idiot"]))[1][0]
    for text in ("an IDIOT!!", "an 1d10t.", "an i d i o t", "an i.d.i.o.t", "an idiiiiot", "x" * 2000 + " idiot"):
        assert plain in reader.read([text])[1], text
    assert len(reader.read(["", "  ", "%%% !!"])[0]) == 0
    probabilities = np.exp(model.reshape(-1, toxicity.SYMBOLS)).sum(axis=1)
    assert np.allclose(probabilities, 1, atol=1e-4)


def test_disguises_at_the_ends_doubled_and_split():
    corpus = ["the idiot and the clown went home with a stupid moron who was not an ass at all, bad boy"] * 30
    reader = toxicity.Reader(toxicity.language_model(toxicity.gram_counts(corpus)))
    cases = {
        "idiot": ("an !diot went", "an |diot", "the iddiot went", "an id iot went", "an id i0t", "an idiiot."),
        "clown": ("the (lown", "the cl own went", "the clo wn", "c lo wn"),
        "moron": ("a mooron went", "a mo ron", "a m0 r on"), "ass": ("an a$$ at", "an as$", "an a s s at"),
    }
    for meant, texts in cases.items():
        plain = codes.words(*codes.flatten([meant]))[1][0]
        for text in texts:
            found = reader.read(["the boy", text, "not at all"])
            assert plain in found[1][found[0] == 1] and plain not in found[1][found[0] != 1], text
    symbols = [1, 2, 3, 3, 1]
    one = [float(toxicity.likelihood(np.array(x), np.array([len(x)]), reader.model)[0]) for x in (symbols[:3], symbols[3:])]
    both = toxicity.likelihood(np.array(symbols), np.array([3, 2]), reader.model)
    assert np.allclose(both, one) and all(x < 0 for x in one)


def test_pieces_of_record_files_take_little_memory():
    import tracemalloc

    counts = np.full(records.READ_BYTES // 2000, 1000)
    units = np.arange(counts.sum(), dtype=np.uint32).astype(np.uint16)
    tracemalloc.start()
    raw, sizes = records.frame(units, counts)
    entries = np.zeros(len(counts), records.ENTRY)
    entries["length"] = sizes
    assert len(records.unframe(raw, entries)) == len(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and records.CACHED_WORDS <= 300_000  # two workers share an executor with the JVM


def test_sets_of_a_unit_are_verified_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
    sets = [np.unique(np.concatenate([base[k % 7 :], rng.integers(0, 1 << 63, 10 * k + 1, np.uint64)])) for k in range(12)]
    names = [bytes([65 + k]) for k in range(12)]
    pairs = np.array(list(itertools.combinations(range(12), 2)), np.int32).T
    rows = list(range(12))[::-1]  # rows come in any order, the pairs with the first place, in two Arrow batches
    table = pa.concat_tables(
        pa.table({
            "class": pa.array([names[k] for k in part], pa.binary()), "place": pa.array(part, pa.int32()), "copies": pa.array([k + 1 for k in part], pa.int64()),
            "pairs": pa.array([pairs.tobytes() if k == 0 else None for k in part], pa.binary()), "shingles": pa.array([sets[k].tobytes() for k in part], pa.binary()),
        })
        for part in (rows[:5], rows[5:])
    )
    links, docs = [0] * 12, [0] * 12
    for a, b in itertools.combinations(range(12), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            links[a], links[b], docs[a], docs[b] = links[a] + 1, links[b] + 1, docs[a] + b + 1, docs[b] + a + 1
    assert 0 < sum(links) < 12 * 11
    compared, plain = [], np.searchsorted
    for limit in (1, 900, 1 << 16):
        monkeypatch.setattr(jaccard, "VERIFIED_SHINGLES", limit)
        monkeypatch.setattr(jaccard.np, "searchsorted", lambda x, y: (compared.append(len(y)), plain(x, y))[1])
        got = jaccard._verify(0.8)(table)
        monkeypatch.setattr(jaccard.np, "searchsorted", plain)
        assert got["class"].to_pylist() == names and got["texts"].to_pylist() == links and got["docs"].to_pylist() == docs
        assert max(compared) < limit + max(map(len, sets))
        compared.clear()
