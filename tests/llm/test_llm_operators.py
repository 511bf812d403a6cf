"""The ten operators against brute force, on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peregrin.llm import chat, decontaminate, entry, lines, minhash, pieces, quality, sharding, suffixes, token_files, warc

tokens = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t long, v long, key string, row int, pos int, fp binary, shard int"


def prose(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["the", "of", "and", "to"] * 20
    return " ".join(r.choice(words) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = prose(20_000, 5)
    rows = [(None, "null id " * 30), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, long), (7, long), (8, long.replace("the", "thee", 3)), (9, "a\x00b ▁ é日本 <|endoftext|> </s>\r\n\x0b x"), (10, "aaaa" * 100)]
    rows += [(20 + i, prose(200, i)) for i in range(30)]
    rows += [(60 + i, prose(200, i).replace(" ", "  ", 2)) for i in range(10)]
    return [*rows, rows[-1], rows[-1]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k else None, None, None, 1, 2, "k", 3, 4, b"x", 5) for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def distinct(texts):
    return sorted({(-(2**63) if k is None else k, t or "") for k, t in texts})


def test_shards(docs, texts, empty):
    r = sharding.shard_by_bytes(docs, 8).orderBy("row").collect()
    assert len(r) == len(texts) and [x.row for x in r] == list(range(len(r)))
    size = collections.Counter()
    for x in r:
        size[x.shard] += x.size
    for s in size:
        assert [x.slot for x in r if x.shard == s] == list(range(sum(x.shard == s for x in r)))
    assert [x.shard for x in r] == sorted(x.shard for x in r)
    assert sorted((x.size, x.text_crc32) for x in r) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    assert max(size.values()) - min(size.values()) <= 2 * max(x.size for x in r)
    rows = sorted((k is not None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    total, before, want, slots = sum(x[2] for x in rows), 0, [], collections.Counter()
    for _, _, n, crc in rows:  # the document whose middle byte is in a shard's share of all bytes
        shard = max(s for s in range(8) if 2 * total * s <= (2 * before + n) * 8)
        want.append((n, crc, shard, slots[shard]))
        before, slots[shard] = before + n, slots[shard] + 1
    assert [(x.size, x.text_crc32, x.shard, x.slot) for x in r] == want
    assert sharding.shard_by_bytes(empty).count() == 0


def test_token_files(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.path("byte_bpe_50k.json")
    token_files.write_token_files(docs, f"file://{tmp_path}/a", path)
    r = token_files.read_token_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    enc = Tokenizer.from_file(path)
    want = [[*enc.encode(t or "", add_special_tokens=False).ids, 0] for _, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    assert [x.ids for x in r] == want
    assert [x.start for x in r] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    token_files.write_token_files(empty, f"file://{tmp_path}/b", path)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_added_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    path = tokens.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    rows = ["a <|endoftext|> b", "plain words", "x<|endoftext|>", "", "é <|endoftext|>  日本 \n", "<|endof text|>"]
    assert [x.tolist() for x in token_files.Encoder(path)(pa.array(rows))] == [fresh.encode(t, add_special_tokens=False).ids for t in rows]


def test_pieces_are_the_library_s():
    from tokenizers import Tokenizer

    path = tokens.path("byte_bpe_50k.json")
    fresh, enc = Tokenizer.from_file(path), token_files.Encoder(path, 3000)
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "a", "the", "Zz", "é", "Ü", "ſ", "12", "7", ".", ",", "--", "'", "''", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'l", "'r", "it's", " 's", "x'sun", "²", "×", "÷", "\xa0", "日", "😀", "\x1c", "\x00", "$#", "<|endoftext|>", "<|", "|>"]
    rows = ["", "'", "'s", " ", "\n", "a'", "'l", "'re", "x" * 5000]
    plain = [b for b in bits if not set(b) & set("²×÷\xa0日😀\x1c<>")]
    rows += ["".join(r.choice(plain if r.random() < 0.9 else bits) for _ in range(r.randrange(1, 30))) for _ in range(6000)]
    rows += [prose(50, i) for i in range(50)]
    for i in range(0, len(rows), 500):
        got = enc(pa.array(rows[i : i + 500]))
        assert [x.tolist() for x in got] == [fresh.encode(t, add_special_tokens=False).ids for t in rows[i : i + 500]]


def test_coder():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (5, 2), (1000, 3), (200_000, 5000)):
        ids = (r.zipf(1.3, n) % kinds).astype(np.uint32)
        u, k = np.unique(ids, return_counts=True)
        t = token_files.Table(*token_files.scaled(dict(zip(u.tolist(), k.tolist(), strict=True))))
        b = token_files.encode_block(ids, t)
        assert (token_files.decode_block(b, t) == ids).all()
        if n > 100_000:
            step = token_files.EVERY * token_files.LANES
            assert (token_files.decode_block(b, t, range(1, 2)) == ids[step : 2 * step]).all()
        with pytest.raises(ValueError):
            token_files.decode_block(b[:-9] + bytes([b[-9] ^ 1]) + b[-8:], t)


def test_leaks(spark, docs, empty):
    item = prose(40, 99)
    near = item.split()
    near[7], near[20] = "other", "OTHER"
    items = spark.createDataFrame([(1, item), (2, prose(30, 98)), (3, None), (4, "too short"), (1, item)], "item_id long, text string")
    more = spark.createDataFrame([(500, "x y z " + " ".join(near) + " more"), (501, "a " + item.upper().replace(" ", " | ")), (502, None), (503, " ".join(near[:15]))], "doc_id long, text string")
    got = decontaminate.find_leaks(docs.select("doc_id", "text").unionByName(more), items).distinct().collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(500, 1, 2), (501, 1, 0)}
    assert {r.start for r in got if r.doc_id == 500} == {3}
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.where("false")).count() == 0


def test_edit_distance():
    r = random.Random(2)
    for n in range(1, 8):
        pairs = [([r.randrange(1, 5) for _ in range(n)], [r.randrange(1, 5) for _ in range(r.randrange(1, 8))]) for _ in range(50)]
        edits, starts, ends = decontaminate.best_runs(np.array([a for a, _ in pairs], np.uint64), np.array([b + [0] * (8 - len(b)) for _, b in pairs], np.uint64))
        for (a, b), k, s, e in zip(pairs, edits, starts, ends, strict=True):
            assert k == min(_levenshtein(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == _levenshtein(a, b[s:e]) and e <= len(b)


def edited(words, kinds, r, letters):
    """words with as many edits as are allowed, at random places."""
    x = words.tolist()
    for j, p in enumerate(sorted(r.choice(len(words), len(words) // 5, replace=False).tolist(), reverse=True)):
        kind = kinds[j % len(kinds)]
        x[p : p + (kind != 2)] = letters(1).tolist() if kind != 1 else []  # 0 replaced, 1 taken out, 2 put in
    return np.array(x, np.uint64)


def test_recall_of_every_item_and_kind_of_edit_at_the_bound():
    r = np.random.default_rng(4)
    letters = lambda n: r.integers(1, 2**63, n, dtype=np.uint64)
    items = [(i, letters(n)) for i, n in enumerate([1, 3, 5, 7, 9, 12, *range(15, 60, 4), 100, 300])]
    index, trials = decontaminate.Index(items), 60
    for kinds in ([0], [1], [2], [0, 1, 2]):
        rows = [np.concatenate([letters(50), edited(w, kinds, r, letters), letters(50)]) for _, w in items for _ in range(trials)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        got = collections.Counter()
        for d, i, start, n, edits in index.search(np.concatenate(rows), at):
            assert d // trials == i and edits <= len(items[i][1]) // 5 and start + n <= len(rows[d])
            got[i] += 1
        assert all(got[i] >= 0.9 * trials for i, _ in items), (kinds, got)


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    pick = lambda n: [r.choice("abcdefghij") for _ in range(n)]
    items = [(i, " ".join(pick(n))) for i, n in enumerate((1, 2, 4, 5, 6, 8, 10, 12, 15, 16))]
    rows = []
    for k in range(80):
        x = pick(r.randrange(0, 25))
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(0, len(w) // 5 + 2)):
            p = r.randrange(len(w)) if w else 0
            w[p : p + r.randrange(2)] = pick(r.randrange(2))
        rows.append((k, " ".join(x + w + pick(r.randrange(0, 5)))))
    want = {}
    for k, t in rows:
        for i, a in items:
            a, b = a.split(), t.split()
            least = min(_levenshtein(a, b[s:e]) for s in range(len(b) + 1) for e in range(s, len(b) + 1))
            if least <= len(a) // 5:
                want[k, i] = least
    letters = {i: decontaminate.word_hashes(pa.array([a]))[0] for i, a in items}
    h, at = decontaminate.word_hashes(pa.array([t for _, t in rows]))
    whole = decontaminate.Index(list(letters.items()), most=0)
    assert {(rows[d][0], i): e for d, i, _, _, e in whole.search(h, at)} == want
    got = {}
    for block in (200_000, 20):
        found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block).collect()
        got[block] = {(x.doc_id, x.item_id): x.edits for x in found}
        assert set(got[block]) <= set(want) and len(got[block]) >= 0.95 * len(want) and all(got[block][k] >= want[k] for k in got[block])


def _levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b):
            d.append(min(old[j] + (x != y), old[j + 1] + 1, d[j] + 1))
    return d[-1]


def removed_lines(rows):
    at = [(k, i, x) for k, t in rows for i, x in enumerate(t.split("\n")) if re.search(r"[^ \t-\r]", x)]
    first = {}
    for k, i, x in sorted(at):
        first.setdefault(x, (k, i))
    near = {x for x in first if len(x) >= 24 and any(y != x and len(y) >= 24 and abs(len(x) - len(y)) < 2 and first[y] < first[x] and _levenshtein(x, y) < 2 for y in first)}
    out = collections.defaultdict(set)
    for k, i, x in at:
        if x in near or first[x] < (k, i):
            out[k].add(i)
    return out


@pytest.mark.parametrize("hot", [lines.HOT, 0.05])
def test_lines(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(lines, "HOT", hot)
    r = random.Random(7)
    base = ["".join(r.choice("ab c") for _ in range(n)) for n in (24, 25, 63, 64, 65, 129, 200)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(3):
            x = r.choice(base)
            p = r.randrange(len(x))
            text.append(r.choice([x, x[:p] + "z" + x[p:], x[:p] + x[p + 1 :], x[:p] + "y" + x[p + 1 :], x[:p] + "yy" + x[p + 2 :], "  ", "ab"]))
        rows.append((k, "\n".join(text)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed_lines(rows)
    got = {x.doc_id: set(x.removed) for x in lines.repeated_lines(d).collect()}
    assert all(got.get(k, set()) == want.get(k, set()) for k, _ in rows)
    out = {x.doc_id: x.text for x in lines.dedup_lines(d).collect()}
    for k, t in rows:
        left = [x for i, x in enumerate(t.split("\n")) if i not in want.get(k, ())]
        assert out[k] == ("\n".join(left) if not want.get(k) or any(x.strip() for x in left) else None)
    again = lines.dedup_lines(docs)
    assert again.columns == docs.columns and again.count() == docs.count() and lines.dedup_lines(empty).count() == 0
    assert {x.text for x in again.where("doc_id = 7").collect()} == {None} and {x.text for x in again.where("doc_id = 1").collect()} == {None}


def test_suffixes(spark, docs, texts, empty):
    rows = distinct(texts)
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.drop_repeats(docs).collect()}
    seen = set()
    for k, t in rows:
        data = t.encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(s)
        c = np.cumsum(gone)[:-1] > 0
        want = (int(c.sum()), int((c[1:] & ~c[:-1]).sum() + c[:1].sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~c].tobytes()).hexdigest())
        assert got[None if k == -(2**63) else k, len(data)] == want
    assert suffixes.drop_repeats(docs).count() == len(texts) and suffixes.drop_repeats(empty).count() == 0


def covered(rows):
    """Of (id, bytes) in order: which bytes lie in a 100-byte string that starts earlier too."""
    seen, out = set(), []
    for _, data in rows:
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(data[i : i + 100])
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def test_suffixes_of_runs_periods_and_shared_passages(spark):
    r = random.Random(11)
    passage = [prose(60, 500 + i)[:n] for i, n in enumerate((99, 100, 101, 150, 400))]
    part = lambda: r.choice([r.choice(passage), "a" * r.randrange(90, 300), *["abcdefg"[:p] * r.randrange(10, 90) for p in range(2, 8)], prose(r.randrange(1, 30), r.randrange(10**6))])
    rows = [(k, "".join(part() for _ in range(r.randrange(1, 8)))) for k in range(300)]
    got = {x.doc_id: x for x in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for (k, t), gone in zip(rows, covered([(k, t.encode()) for k, t in rows]), strict=True):
        assert bytes(got[k].kept) == np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
        assert got[k].n_spans == int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()) and got[k].n_bytes == len(t.encode())


def test_suffixes_of_very_long_texts(spark):
    n = 5_000_000
    rows = [(1, "a" * n), (2, "ab" * (n // 2)), (3, "x" + "a" * 150 + "ab" * 100)]
    got = {x.doc_id: x for x in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (n - 1, n - 2)
    assert bytes(got[3].kept) == b"x"


def test_loser_tree():
    r = random.Random(3)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted("".join(r.choice("ab") for _ in range(6)).encode() for _ in range(r.randrange(0, 9))) for _ in range(k)]
        same = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
        coded = [[(same(x[i - 1], x[i]) if i else 0, x[i], (j, i)) for i in range(len(x))] for j, x in enumerate(runs)]
        out = list(suffixes.LoserTree(coded))
        assert [x[1] for x in out] == sorted(b for x in runs for b in x)
        assert all(p == same(a[1], b) for a, (p, b, _) in zip(out, out[1:], strict=False))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ü\r\nX: y", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (9, "u", ""), (None, "u", "alone"), (7, "u", "é" * 70_000), (8, "u", "ab\r\n\r\ncd")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, last long, sha1 string").repartition(3)
    path = f"file://{tmp_path}/w"
    assert warc.write_warc(pages, path) == len(rows)
    got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    last = {}
    for k, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if k is None else k)
    for k, _, h in rows:
        r, data = got[f"<urn:page:{'' if k is None else k}>"], (h or "").encode()
        response = k is None or last[h or ""] == k
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("response" if response else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.refers_to == (None if response else f"<urn:page:{last[h or '']}>") and (bytes(r.payload) == data if response else r.payload is None)
    only = warc.read_warc(spark, path).where(F.col("record_type") == "revisit")
    assert only.count() == sum(r.record_type == "revisit" for r in got.values())
    assert warc.read_warc(spark, path).where(F.col("record_id").isin("<urn:page:7>")).count() == 1
    assert warc.write_warc(pages.where("false"), f"file://{tmp_path}/e") == 0 and warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)  # a member without the length field is inflated to find its end
    plain = zip_.compress(warc._record(1, "u", b"x", None, "D")) + zip_.flush()
    (tmp_path / "p.warc.gz").write_bytes(plain + plain)
    assert warc.read_warc(spark, f"file://{tmp_path}/p.warc.gz").count() == 2
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}/p.warc.gz", payload=False, verify=True).count()
    assert warc.read_warc(spark, path, payload=False, verify=True).where("payload is null").count() == len(rows)


def test_warc_of_others(spark, tmp_path):
    head = b"WARC/1.0\r\nwarc-type: %s\r\nWARC-RECORD-ID:  <urn:%d>\r\nContent-Length: %d\r\nX: a\r\n b: c\r\n\r\n"
    rows = [(b"warcinfo", b"software: x"), (b"response", b"HTTP/1.1 200 OK\r\nCONTENT-LENGTH: 5\r\n\r\nhello"), (b"resource", b"y" * 100_000), (b"request", b"GET / HTTP/1.1\r\n\r\n"), (b"metadata", b""), (b"revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"), (b"conversion", b"z")]
    records = [head % (t, i, len(x)) + x + b"\r\n\r\n" for i, (t, x) in enumerate(rows)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc").write_bytes(b"".join(records))
    (tmp_path / "a/y.warc.gz").write_bytes(b"".join(warc.gzip_member(x) for x in records))
    d = warc.read_warc(spark, f"file://{tmp_path}/a")
    got = collections.Counter((r.record_type, r.record_id, None if r.payload is None else bytes(r.payload)) for r in d.collect())
    body = {b"response": b"hello", b"revisit": None}
    assert got == {(t.decode(), f"<urn:{i}>", body.get(t, x)): 2 for i, (t, x) in enumerate(rows)}
    assert d.where("payload is not null").count() == 12 and d.where("record_type = 'resource' and payload is not null").count() == 2


def test_warc_attempts(spark, tmp_path):
    """Files that no manifest names, as of a failed or doubled attempt, are not read; those it names must be there."""
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").repartition(3)
    path = tmp_path / "w"
    assert warc.write_warc(pages, f"file://{path}") == 20
    files = sorted(path.glob("*.warc.gz"))
    (path / "part-00000-0000-other.warc.gz").write_bytes(files[0].read_bytes())
    (path / "part-00001-0000-torn.warc.gz").write_bytes(files[0].read_bytes()[:30])
    assert warc.read_warc(spark, f"file://{path}").count() == 20
    files[0].unlink()
    with pytest.raises(Exception, match="manifest"):
        warc.read_warc(spark, f"file://{path}").count()


def test_quality(spark, docs, texts, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, r.n_words, r.word_chars): r for r in got}
    for k, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        x = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = by[k, len(w), sum(map(len, w))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(t.count, "#*$%&|<>")), len(x) - len(set(x)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_verdict_of_quality(spark):
    """kept and both distances against plain Python, with references pooled over the rows that the base rules leave."""
    r = random.Random(9)
    english = quality.COMMON["en"] + "house river stone walking Green morning".split()
    rows = [(i, lang, " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))) for i, (lang, words, n) in enumerate([("en", english, 200)] * 12 + [("en", ["zq!!", "$$", "123", "XK"], 120)] * 2 + [("de", quality.COMMON["de"] + ["Haus", "Öl"], 90)] * 6 + [("xx", english, 100)] + [("en", english, 60), ("en", ["the"], 90)])]
    rows += [(99, None, None), (100, "en", "")]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    classes = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[^\x00-\x7F]"]
    hist = {}
    for k, lang, t in rows:
        words, chars = re.findall(r"[^\x20\x09-\x0D]+", t or ""), re.sub(r"[\x20\x09-\x0D]", "", t or "")
        counts = []
        for c in classes:
            counts.append(len(re.findall(c, chars)))
            chars = re.sub(c, "", chars)
        common = quality.COMMON.get(lang, [])
        own = [sum(w in (c, c.capitalize(), c.upper()) for w in words) for c in common]
        hist[k] = (np.array([*counts, len(chars)]), np.array([*own, len(words) - sum(own)]), len(words), sum(map(len, words)))

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return np.sqrt(max(0, part(p) + part(q)) / 2)

    verdicts = set()
    for k, lang, _ in rows:
        of = [j for j, x, _ in rows if x == lang and lang in quality.COMMON and not got[j].base_failed]
        c = distance(hist[k][0], sum(hist[j][0] for j in of)) if of and hist[k][3] >= quality.MIN_CHARS else None
        w = distance(hist[k][1], sum(hist[j][1] for j in of)) if of and hist[k][2] >= quality.MIN_WORDS else None
        assert got[k].class_distance == pytest.approx(c, abs=1e-9) and got[k].word_distance == pytest.approx(w, abs=1e-9)
        assert got[k].kept == (not got[k].base_failed and (c or 0) <= quality.MAX_CLASS_DISTANCE and (w or 0) <= quality.MAX_WORD_DISTANCE)
        verdicts.add((got[k].base_failed, got[k].kept))
    assert verdicts == {(True, False), (False, False), (False, True)}


def test_js_distance(spark):
    p, q = [3, 1, 0, 6], [1, 1, 5, 3]
    r = spark.createDataFrame([(p, q)], "p array<long>, q array<long>").select(quality.js_distance(F.col("p"), F.col("q"))).first()[0]
    a, b = np.array(p) / 10, np.array(q) / 10
    m = (a + b) / 2
    kl = lambda x: sum(i * np.log2(i / j) for i, j in zip(x, m, strict=True) if i)
    assert r == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_events_fold(spark):
    e = [(1, 1, 1, "open", "user", "q"), (1, 2, 2, "open", "assistant", ""), (1, 2, 3, "delta", None, "he"), (1, 2, 5, "delta", None, "lo"), (1, 3, 6, "open", "user", "later"), (1, 2, 7, "regenerate", None, None), (1, 2, 8, "delta", None, "new"), (1, 1, 9, "edit", None, "Q"), (1, 2, 10, "open", "assistant", "re"), (1, 2, 11, "delta", None, None), (2, 1, 1, "open", None, None)]
    d = spark.createDataFrame(e, "conv_id long, msg long, seq long, kind string, role string, text string").repartition(3)
    got = {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold_events(d).collect()}
    assert got == {(1, 1): ("user", "Q"), (1, 2): ("assistant", "re"), (2, 1): ("", "")}


def test_chat_round_trip(spark):
    odd = ["", None, "\\### Assistant: </turn> ok", "#" * 9, "\\\\s\\h", "</turn>\n", "é" * 2000, "a\n### user: b"]
    rows = [(1, i, r, t) for i, (t, r) in enumerate(zip(odd, ["user", "assistant", "assistant", None, "a: b", "system", "assistant", "user"], strict=True))]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "user", "y"), (3, None, "assistant", "z")]
    d = spark.createDataFrame([(*r, "k", 7) for r in rows], "conv_id long, turn long, role string, text string, head string, msg long")
    folded = lambda d, n=512: chat.fold_events(chat.turns_to_events(d, n, True), chat.TURN)
    for n in (1, 3, 512):  # drafts, edits and regenerations leave no trace
        assert sorted(map(str, folded(d, n).collect())) == sorted(map(str, chat.fold_events(chat.turns_to_events(d), chat.TURN).collect()))
    kinds = {r.kind for r in chat.turns_to_events(d, 512, True).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}
    rendered = chat.render(folded(d), message=chat.TURN)
    for r in rendered.collect():
        escaped = [x.split(": ", 1)[1] for x in r.formatted.split(chat.TAIL)[:-1]]
        assert [r.formatted[s.offset : s.offset + s.length] for s in r.loss] == [escaped[s.turn] for s in r.loss]
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert back[1].learned == ["", odd[2], odd[6]] and len(back[2].turns) == 2 and back[3].learned == ["z"]
    assert chat.read_back(chat.render(folded(d.where("false")), message=chat.TURN)).count() == 0


def test_minhash(docs, texts, empty):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = distinct(texts)
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = list(sets)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        k = -(2**63) if r.doc_id is None else r.doc_id
        assert r.n_shingles == len(sets[k]) and (-(2**63) if r.component_id is None else r.component_id) == find(k) and r.kept == (find(k) == k)
    assert minhash.near_duplicates(empty).count() == 0


def test_bayes_limits():
    least = dict(minhash.least_matches(0.85, 1e-7))
    assert 0 < least[16] < least[128] < 0.85 * 128


def test_pieces(docs, texts, empty):
    import sentencepiece

    path = tokens.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    assert len(got) == len(texts)
    want = collections.Counter((k, tuple(sp.encode(t or ""))) for k, t in texts)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    size = {(k, tuple(sp.encode(t or ""))): len((t or "").encode()) for k, t in texts}
    for r in got:
        assert r.decoded == sp.decode(r.ids) and (r.ends[-1] if r.ends else 0) == size[r.doc_id, tuple(r.ids)]
    whole = {str(r.ids): r.ends for r in got}
    for _, t in texts:
        said = sp.encode(t or "", return_type="proto").pieces
        ends = whole[str([p.id for p in said])]
        for e, p in zip(ends, said, strict=True):  # the library gives the bytes of a character without a piece one span
            assert e == p.end or p.piece.startswith("<0x")
    assert pieces.encode(empty, path).count() == 0


def trie(entries):
    """A double array for a character map, by trying offsets."""
    units, used = {0: 0}, {0}

    def place(node, prefix):
        below = sorted({e[len(prefix)] for e in entries if e[: len(prefix)] == prefix and len(e) > len(prefix)})
        leaf = prefix in entries
        base = next(b for b in range(1, 1 << 20) if not ({b ^ c for c in below} | ({b} if leaf else set())) & used)
        used.update({b ^ base for b in below} | ({base} if leaf else set()))
        units[node] = units.get(node, 0) | ((node ^ base) << 10) | (int(leaf) << 8)
        if leaf:
            units[base] = entries[prefix] | 1 << 31
        for c in below:
            units[base ^ c] = c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    return b"".join(struct.pack("<I", units.get(i, 0xFF)) for i in range(-(-(max(units) + 1) // 256) * 256))


def test_character_map(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(tokens.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    strings, entries = b"", {}
    for a, b in (("ﬁ", "fi"), ("½", "1/2"), ("é", "e"), ("é", "E"), ("　", " "), ("x", "")):
        entries[a.encode()] = len(strings)
        strings += b.encode() + b"\0"
    blob = trie(entries)
    m.normalizer_spec.precompiled_charsmap = struct.pack("<I", len(blob)) + blob + strings
    m.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Encoder(str(path))
    r = random.Random(1)
    rows = ["ﬁx é ½", "  a  b  ", "x", "", "日　本"] + ["".join(r.choice("ﬁ½é　x ab日é") for _ in range(r.randrange(1, 20))) for _ in range(500)]
    for t, (ids, ends) in zip(rows, enc(rows), strict=True):
        assert ids.tolist() == sp.encode(t)
        assert (np.diff(ends) >= 0).all() and (not len(ends) or ends[-1] <= len(t.encode()))


def test_stages(spark, texts, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = prose(40, 99)
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts if k is not None] + [(900, prose(100, 77) + " " + item + " " + prose(100, 78), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == pipeline.COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 900 in kept["minhash near-dedup"] and 900 not in kept["benchmark decontamination"]
    assert not {1, 2, 3, 4, 5} & kept["quality rules"] and 6 in kept["benchmark decontamination"] and 7 not in kept["line dedup"]
    out = pipeline.run(spark, f"file://{tmp_path}")
    assert {r.doc_id for r in out.collect()} == kept["benchmark decontamination"]


def test_stages_judge_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = prose(40, 99)
    clean = [prose(200, 300 + i) for i in range(5)]
    leak = prose(100, 77) + " " + item + " " + prose(100, 78)
    near = clean[3].rsplit(" ", 2)[0]
    rows = [(None, clean[0]), (None, clean[1]), (None, "zz"), (None, leak), (1, clean[2]), (1, "zz too"), (1, leak), (2, clean[3]), (2, clean[4]), (2, clean[4]), (0, near)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage: collections.Counter((r.doc_id, r.text) for r in stage(spark, docs, f"file://{tmp_path}").collect())
    assert left(pipeline.quality_rules) == collections.Counter((k, t) for k, t in rows if "zz" not in t)
    assert left(pipeline.benchmark_decontamination) == collections.Counter((k, t) for k, t in rows if t != leak)
    assert left(pipeline.minhash_near_dedup) == collections.Counter({(k, t) for k, t in rows} - {(1, leak), (2, clean[3])})


def test_stages_of_empty_tables_and_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, items in (("none", [], []), ("odd", [(None, None, None, None, None), (1, "", None, None, None), (2, " \n\t", "en", None, None), (3, None, "en", "s", 0), (4, prose(300, 1), None, None, None), (4, prose(300, 1), None, None, None)], [(1, None), (2, ""), (None, "xyzzy")])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert [r.doc_id for r in pipeline.run(spark, folder).collect()] == ([4] if rows else [])
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        clash = docs.selectExpr("*", "1 as __key", "'x' as item_id", "2 as v", "3 as h", "4 as k", "5 as kept", "6 as fp")
        for title, stage in pipeline.STAGES[:4]:
            same = lambda d: collections.Counter(map(str, d.collect()))
            assert same(stage(spark, clash, folder)) == same(stage(spark, docs, folder)), title


def test_scratch_is_removed(spark, tmp_path):
    from peregrin.llm import common

    with common.scratch(spark):
        t = common.staged(spark.range(5).toDF("id"), "x")
        assert t.count() == 5
    assert not os.path.exists(t._peregrin_path.removeprefix("file://"))
    t = common.staged(spark.range(5).toDF("id"), "x")
    common.discard(t)
    assert not os.path.exists(t._peregrin_path.removeprefix("file://"))


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    said = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in said.fetchall()), key=str)
