"""Toxicity, pseudonyms, token files and WARC archives."""
import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from tablewright.llm import files, pseudonyms, shared, tokens, toxicity, warc
from tablewright.session import scratch_path


# ---------------------------------------------------------------- toxicity

def _maximal(scores: list[float]) -> list[tuple[int, int]]:
    """Maximal scoring segments by their definition: the best one, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if (s := sum(scores[i:j])) > best + 1e-9:
                best, at = s, (i, j)
    if at is None:
        return []
    shift = [(a + at[1], b + at[1]) for a, b in _maximal(scores[at[1]:])]
    return [*_maximal(scores[:at[0]]), at, *shift]


@pytest.mark.parametrize("seed", range(5))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    for _ in range(40):
        values = [rng.choice([toxicity.DRIFT] * 3 + [0.3, 1.1, 2.7]) for _ in range(rng.randint(0, 14))]
        known = {b"%d" % i: v for i, v in enumerate(values)}
        model = toxicity.Model({})
        got = [(a, b) for a, b, _ in model.segments(list(known), known)]
        want = _maximal(values)
        assert [round(sum(values[a:b]), 6) for a, b in got] == [round(sum(values[a:b]), 6) for a, b in want], (values, got, want)


def test_segments_take_time_in_proportion():
    known = {b"c": 0.3, b"z": toxicity.DRIFT}
    tokens_ = ([b"c"] + [b"z"] * 9) * 100_000  # isolated words that never join
    start = time.perf_counter()
    assert len(toxicity.Model({}).segments(tokens_, known)) == 100_000
    assert time.perf_counter() - start < 2.0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = (shared.table(spark, d, t) for t in ("documents", "labels"))
    scored = toxicity.score(documents, toxicity.train(documents.select("doc_id", "text"), labels))
    rows = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert np.mean([r["predicted"] for r in clean]) < 0.03 and np.mean([r["predicted"] for r in toxic]) > 0.5
    above = [(t["score"] > c["score"]) + 0.5 * (t["score"] == c["score"]) for t in toxic for c in clean]
    assert np.mean(above) > 0.8


def test_toxicity_edges(spark):
    documents = spark.createDataFrame([(1, None), (2, ""), (None, "word"), (3, "x " * 30_000), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int")):
        rows = toxicity.score(documents, toxicity.train(documents, labels)).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["passages"] == [] for r in rows)
    assert toxicity.score(documents.limit(0), toxicity.Model({})).count() == 0


# ---------------------------------------------------------------- pseudonyms

def _masked(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_private string")
    return [(r["text"], r["n_private"]) for r in pseudonyms.pseudonymise(df, "key").orderBy("doc_id").collect()]


def _luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    (a, n), (b, m) = _masked(spark, "card 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00; 2001-02-28, +1 (017) 555-7713!",
                             "again 4111111111111111 and 28.2.2001 or 10.1.2.3 or a.b@c.example")
    assert (n, m) == (4, 4)
    card, other = a[5:24], b.split()[1]
    assert _luhn(card) and card.replace(" ", "") == other and card[4] == " " and other != "4111111111111111"
    account = a.split(", ")[1].split(";")[0].replace(" ", "")
    assert int(account[4:] + "1314" + account[2:4]) % 97 == 1 and account.startswith("DE")
    year, month, day = a.split("; ")[1].split(",")[0].split("-")
    assert f"{int(day)}.{int(month)}.{year}" == b.split()[3]
    assert a.endswith("!") and "+1 (" in a and "555-7713" not in a and "@c.example" in b and "a.b@" not in b


def test_pseudonyms_leave_the_rest(spark):
    same = [None, "", "plain text 12 345", "4111111111111112", "1999-02-29 31.2.2000 300.1.1.1 000-12-3456", "v1.2.3 2.0.", "é" * 20_000]
    assert _masked(spark, *same) == [(t, 0) for t in same]
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "text string"), "key").count() == 0


def test_pseudonyms_beside_other_numbers(spark):
    """A value has the pseudonym that it has alone, whatever number stands beside it."""
    card, other, address, phone, day = "4111111111111111", "5500 0000 0000 0004", "190.137.223.204", "+1 (826) 555-4081", "2001-02-28"
    more = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+4930123456", "+420 123 456 789", "+34 91 234 56 78", "+49 (30) 12 34 56 78"]
    values = [card, other, address, phone, day, "28.2.2001", *more]
    alone = dict(zip(values, _masked(spark, *values)))
    assert all(n == 1 and masked != v and (v[0] != "+" or v[-2:] not in masked[-2:] or masked[:-2] != v[:-2]) for v, (masked, n) in alone.items())
    beside = [[a, b] for a in values for b in values] + [[a, "12"] for a in values] + [["12", card], ["7", other, "8", card, "9"], [card, "12ab"]]
    got = _masked(spark, *[" ".join(x) for x in beside])
    for x, (masked, n) in zip(beside, got):
        assert (masked, n) == (" ".join(alone[v][0] if v in alone else v for v in x), sum(v in alone for v in x)), x
    run = "12 " * 20_000
    assert _masked(spark, run + card)[0][0].count(" ") == 20_000


def test_pseudonyms_of_secrets_without_digits(spark):
    secret = 'password = "correct-horse-battery"'
    (alone, n), (beside, m) = _masked(spark, secret, secret + " 7")
    assert n == m == 1 and "horse" not in alone and beside == alone + " 7"


def _mod_97(account: str) -> int:
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_pseudonyms_of_accounts_with_letters_and_long_secrets(spark):
    spaced = ["GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
              "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"]
    got = _masked(spark, *spaced, *[x.replace(" ", "") for x in spaced], "GB82 WEST 1234 5698 7654 33", spaced[4] + " 4111111111111111")
    for x, (a, n), (b, m) in zip(spaced, got, got[len(spaced):]):
        assert n == m == 1 and a != x and a.replace(" ", "") == b and _mod_97(a) == 1 and a[:2] == x[:2]
        assert [(c.isdigit(), c.isupper()) for c in a] == [(c.isdigit(), c.isupper()) for c in x]
    assert got[-2] == ("GB82 WEST 1234 5698 7654 33", 0) and got[-1][1] == 2
    secrets = ["a" * n for n in (64, 65, 128, 500)] + ["a" * 499 + "b"]
    masked = [t for t, n in _masked(spark, *[f'token = "{x}"' for x in secrets]) if n == 1]
    assert [len(t) for t in masked] == [len(x) + 10 for x in secrets] and not any("aaaa" in t for t in masked)
    assert masked[3] != masked[4]
    short = spark.createDataFrame([(a + b,) for a in pseudonyms._LETTERS for b in pseudonyms._LETTERS], "a string")
    assert short.select(pseudonyms.permuted_letters(F.col("a"), F.lit("t"), "key")).distinct().count() == 676


def test_feistel_is_a_permutation(spark):
    digits = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    there = digits.withColumn("p", pseudonyms.permuted_digits(F.col("d"), "t", "key"))
    back = there.withColumn("b", pseudonyms.permuted_digits(F.col("p"), "t", "key", inverse=True))
    assert back.where("b <> d or length(p) <> 4").count() == 0 and there.select("p").distinct().count() == 10_000
    assert there.where("p = d").count() < 20


# ---------------------------------------------------------------- token files

def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    odd = ["", None, " a  b\n\n c", "don't  stop\t", "end\n", "\nx", "<|endoftext|> y", "a b<|endoftext|>", "tab\ty", "x" * 40_000,
           "漢字 😀 mixed ", "same", "same", "nul", "a b"]
    rows = [(i % 13, t, 1) for i, t in enumerate(odd)] + [(None, "no id", 1)]
    rows += [(100 + i, f"Ordinary words number {i}, again and again.\nLine two {i * i}.", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = scratch_path(spark, "tokens")
    parts = tokens.write(df, folder, path)
    coded = {}
    for doc_id, text, _ in rows:
        coded.setdefault(doc_id, []).append([*plain.encode(text or "", add_special_tokens=False).ids, 0])
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in tokens.read(spark, folder, parts).collect())
    assert len(got) == len(rows)
    start, before = 0, -1
    for at, doc_id, ids in got:
        assert at == start and (doc_id is None and before == -1 or doc_id >= before) and ids in coded[doc_id]
        start, before = start + len(ids), -1 if doc_id is None else doc_id
    sums = {(r["doc_id"], r["ids_crc32"]) for r in tokens.checksums(spark, folder, parts).collect()}
    assert sums == {(d, zlib.crc32(np.array(i, "<u4").tobytes())) for d, all_ in coded.items() for i in all_}
    with files.reading(f"{folder}/dictionary") as f:
        dictionary = f.read()
    found = []
    for r in parts.collect():
        with files.reading(r["path"]) as f:
            part = tokens.Part(f, dictionary)
            found += [x.tolist() for i in (150, 399, 7) if (x := part.find(i)) is not None]
            assert part.find(99_999) is None
            with pytest.raises(ValueError):
                tokens.Part(f, dictionary + b"x")
    assert coded[150][0] in found and coded[399][0] in found


def test_token_files_of_an_empty_table(spark):
    folder = scratch_path(spark, "tokens")
    parts = tokens.write(spark.createDataFrame([], "doc_id long, text string"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert parts.count() == 0 and tokens.read(spark, folder, parts).count() == 0


# ---------------------------------------------------------------- archives

def test_url_keys():
    assert warc.url_key("https://User@M.Example.com:443/a/b?q=1#top") == "com,example,m)/a/b?q=1"
    assert warc.url_key("http://example.com") == "com,example)/" and warc.url_key(None) == "" == warc.url_key("")
    assert warc.url_key("http://[broken") == "http://[broken"


def test_archive_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, f"http://h{i % 7}.example/p{i % 11}", f"<p>page {i % 30}</p>" * (i % 5)) for i in range(90)]
    rows += [(200, None, None), (201, "x\r\ny z", "é"), (None, "http://q/", "<p>page 3</p>" * 3), (89, "http://again/", rows[89][2]), (300, "http://big/", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc")
    index = warc.index(warc.archive(df, folder), folder)
    assert index.agg(F.sum("lines")).first()[0] == len(rows)
    largest = {}
    for page_id, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page_id is None else page_id)
    got = warc.fetch(warc.lookup(df, index)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["page_id"], []).append(r)
    for page_id, url, html in rows:
        body, owner = (html or "").encode(), largest[html or ""]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if owner in (page_id, -1) else ("revisit", owner)))
        assert want in [(r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in by_id[page_id]]
        assert all(r["payload"] == bytearray(body) for r in by_id[page_id] if r["record_type"] == "response")
    some = spark.createDataFrame([("http://h3.example/p3",), ("http://H3.example/p3#x",), ("http://none/",)], "url string")
    hits = warc.lookup(some, index).collect()
    assert sorted(r["page_id"] for r in hits) == sorted(r[0] for r in rows if r[1] == "http://h3.example/p3")


def test_small_payloads_are_not_merged_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    index = warc.index(warc.archive(df, folder, least_bytes=5), folder)
    assert {r["page_id"]: r["refers_to"] for r in warc.fetch(warc.lookup(df, index)).collect()} == {1: None, 2: None, 3: 4, 4: None}
    empty = df.limit(0)
    folder = scratch_path(spark, "warc")
    index = warc.index(warc.archive(empty, folder), folder)
    assert index.count() == 0 and warc.fetch(warc.lookup(df, index)).count() == 0


def test_encoder_gives_the_library_s_ids():
    """Texts of everything that the shortcut for words has to get right."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokens.Encoder(path, 0), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = ["a", "b", "The", "é", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2003", "\x85", "\x1c", "\x0b", "1", "23", ",", ".", "'s", "<|endoftext|>", "中",
            "-", "_", "...", "!", "Ġ", "\ud7ff", "x,y", "don't", "İ", "ß", " \n", "\n ", "###", "&&", "*", "łó", "ñ", "ª", "²", "Ⅳ", "ʰ", "ǅ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += [" ".join(rng.choice(["foo,", "Bar.", "b\nc", "é;", "x!", "(y)", "1.5", "a b"]) for _ in range(20)) for _ in range(100)]
    got = encoder.encode(pa.array(texts)) + encoder.encode(pa.array([None, ""], pa.string()))
    want = [c.ids for c in library.encode_batch_fast(texts, add_special_tokens=False)] + [[], []]
    assert got == [np.array([*ids, 0], "<u2").tobytes() for ids in want]


def test_words_are_held_once_and_for_two_generations(monkeypatch):
    """Punctuation behind words makes no words of their own, and ids stay right when words are let go and come again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokens.Encoder(path, None), tokenizers.Tokenizer.from_file(path)
    encoder.encode(pa.array(["word word. word, word!! été été; 12 12."]))
    assert {w for w in encoder.words if w[0].isalnum()} == {"word", "été", "12"}
    for texts in ([""], ["a  b"], [None], []):  # nothing to look up, in a new encoder
        ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert tokens.Encoder(path, None).encode(pa.array(texts, pa.string())) == [np.array(i, "<u2").tobytes() for i in ids]
    monkeypatch.setattr(tokens, "_CACHED_WORDS", 40)
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in ("foo", "Bär", "łó", "中", "x1", "\n") for b in ("", "ing", "²", "ß") for c in ("", ".", ",!", "-", "'s")]
    for _ in range(60):
        texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(8)]
        want = [np.array(c.ids, "<u2").tobytes() for c in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert encoder.encode(pa.array(texts)) == want
    assert encoder.before and len(encoder.ends) == 1 + len(encoder.words.keys() | encoder.before.keys())
