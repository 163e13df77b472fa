"""WARC archives, collocations and conversation repair on small tables, against brute force and round trips."""

import gzip
import hashlib
import heapq
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from keystead.llm import collocations as co
from keystead.llm import decontaminate, repair, warc
from keystead.storage import new_path

# ---- 11 archives

PAGES = "page_id long, url string, html string, payload string, record_id int, head string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, None, "d") for i, u, h in rows], PAGES)


def test_archive_round_trip(spark):
    long, odd = "é\r\n\r\n" * 60, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 4
    rows = [
        (5, "http://a/?q=1 2", long), (2, None, long), (None, "u", long), (2, "again", long), (7, "bad\r\nX: y", None), (8, "e", ""),
        (9, "s", "x" * 99), (10, "s", "x" * 99), (11, "l", "x" * 100), (12, "l", "x" * 100), (13, "odd", odd), (14, "odd", odd), (15, "big", "y" * 3_000_000),
    ]
    path = new_path(spark, "warc")
    records = warc.archive(pages(spark, rows), path)
    kept = records.collect()
    assert len(kept) == len(rows) and all(r.intact for r in kept) and len({r.record_id for r in kept}) == len(rows)
    facts = [tuple(r) for r in warc.headers_of(records).collect()]
    want = []
    for n, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        same = sorted((p is None, p or 0, k) for k, (p, _, h) in enumerate(rows) if (h or "") == (html or ""))
        first = rows[same[0][2]][0]
        again = len(data) >= 100 and (same[0][2] != n)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(facts, key=repr) == sorted(want, key=repr)
    assert {(r.page_id, r.url) for r in kept if r.page_id in (2, 7)} == {(7, "bad%0D%0AX:%20y"), (2, None), (2, "again")}
    odd_back = [r for r in kept if r.page_id == 13][0]
    assert bytes(odd_back.payload).decode() == odd


def test_files_are_archives(spark):
    path = new_path(spark, "warc")
    warc.write_archives(warc.responses(pages(spark, [(1, "http://a/", "<p>one</p>")]), "page_id", "url", "html", "2024-01-01T00:00:00Z"), path)
    raw = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect())
    assert re.fullmatch(
        rb"WARC/1\.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
        rb"WARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha256:[0-9a-f]{64}\r\nPage-ID: 1\r\n"
        rb"Content-Type: application/http; msgtype=response\r\nContent-Length: (\d+)\r\n\r\nHTTP/1\.1 200 OK\r\n.*\r\n\r\n<p>one</p>\r\n\r\n",
        raw,
        re.S,
    )


def test_archives_written_by_others(spark, tmp_path):
    """Records of another kind, other case of the field names, several members in a file, and a record that is cut off."""
    one = b"WARC/1.1\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:a>\r\ncontent-length: 5\r\nContent-Type: text/plain\r\n\r\nhello\r\n\r\n"
    two = one.replace(b"urn:a", b"urn:b").replace(b"hello", b"WARC/").replace(b"text", b"test")
    cut = one.replace(b"urn:a", b"urn:c").replace(b"length: 5", b"length: 500")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(cut))
    got = {r.record_id: (r.record_type, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"urn:a": ("resource", b"hello"), "urn:b": ("resource", b"WARC/")}


def test_archive_of_nothing(spark):
    assert warc.headers_of(warc.archive(pages(spark, []), new_path(spark, "warc"))).collect() == []


# ---- 12 collocations


def brute_collocations(rows, least, most):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            found = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(found)
            for size in (1, 2, 3):
                for i in range(len(found) - size + 1):
                    key = lang, tuple(found[i : i + size])
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    for (lang, phrase), a in counts.items():
        if len(phrase) < 2 or a < least:
            continue
        around = [c for (other, long), c in counts.items() if other == lang and len(long) > len(phrase) and c >= least and phrase in (long[:-1], long[1:])]
        if any(100 * c >= 50 * a for c in around):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    return sorted(
        (lang, n, p.decode(), -a, left, right, total[lang], -s)
        for lang, found in out.items()
        for n, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)
    )


def test_collocations_equal_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    words = ["New", "york", "times", "the", "of", "é", "Ünder", " x", "a"]
    rows = [
        (draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(draw.randrange(60))))
        for _ in range(120)
    ]
    rows += [("en", None), ("en", ""), ("fr", " .,. "), ("en", "new york " * 300), rows[0], rows[0]]
    df = spark.createDataFrame([(t, g, 1, "p", "r") for g, t in rows], "text string, lang string, n int, phrase string, rest string")
    for least, most, size in ((10, 2000, 8 << 20), (3, 7, 40)):
        monkeypatch.setattr(co, "SLICE", size)
        got = sorted(tuple(r) for r in co.collocations(df.repartition(3), least, most).collect())
        assert got == brute_collocations(rows, least, most) and len(got) > 10


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("...", "en")], [("one", "en")]):
        assert co.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    a, left, right = 9_000_000_000_001, 9_000_000_000_003, 9_000_000_000_007
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(co.exact_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)


def test_more_words_than_fit_three_to_a_key():
    import numpy as np

    ids, piece = np.array([5, 1 << 22, 7, 5, 1 << 22, 7, 9]), np.zeros(7, int)
    found, n = co.grams(ids, piece, 3, (1 << 22) + 1)
    assert sorted(zip(*[x.tolist() for x in found], n.tolist(), strict=True)) == [
        (5, 1 << 22, 7, 2), (7, 5, 1 << 22, 1), (1 << 22, 7, 5, 1), (1 << 22, 7, 9, 1),
    ]


# ---- 13 conversations


def brute_repair(codes):
    """Cheapest edits by shortest paths over (cost, letters)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (0, 3):
            return cost, letters
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 5, letters + "I", i, repair.TURN[state]))
        if i < len(codes):
            initial, fault = codes[i] & 3, codes[i] >> 2
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state))
            if fault != repair.GONE:
                extra = 5 if fault == repair.CUT else 0
                if repair.KEEP[state][initial] >= 0:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, repair.KEEP[state][initial]))
                heapq.heappush(heap, (cost + extra + 1, letters + "R", i + 1, repair.TURN[state]))
    return None


def test_search_equals_shortest_paths():
    draw = random.Random(2)
    for _ in range(4000):
        codes = bytes(draw.choice([0, 1, 2, 3]) + 4 * draw.choice([0, 0, 0, 1, 2]) for _ in range(draw.randrange(14)))
        want = brute_repair(codes)
        for segment in (1, 2, 3, 64):
            assert repair.cheapest(codes, segment) == want


def test_search_uses_the_bounds(monkeypatch):
    """With no estimate at all the answer is the same: the bounds then rise one by one."""
    codes = bytes([1, 1, 2 + 8, 0, 5, 3, 2, 2, 1, 9, 2])
    want = brute_repair(codes)
    monkeypatch.setattr(repair, "forced", lambda codes: [0] * (len(codes) + 1))
    assert repair.cheapest(codes) == want


def test_long_conversations(spark):
    draw = random.Random(3)
    codes = bytes((1 + (i + (draw.random() < 0.05)) % 2) + 4 * draw.choice([0] * 17 + [1, 1, 2]) for i in range(20_000))
    cost, letters = repair.cheapest(codes)
    short = repair.deepen(codes[:2000], 0, repair.ACCEPT, True)
    assert (short[0], short[1]) == repair.cheapest(codes[:2000]) and cost > short[0] and len(letters) >= len(codes)


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, place int, head boolean"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], CONVERSATIONS)


def test_repaired_conversations(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "assistant", "Hello!"),
        (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 2, "assistant", "cut off"), (2, 3, "assistant", "Yes."),
        (3, None, None, None), (3, None, "tool", " \n"), (None, 1, "user", "Q?"), (None, 2, "agent", "A. "),
        (4, 5, "user", "a." * 400_000), (4, 6, "assistant", "b."), (4, 9, "user", "b."), (4, None, "user", "b."),
    ]
    got = {r.conv_id: r for r in repair.repair(conversations(spark, rows).repartition(4)).collect()}
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert tuple(got[1])[1:] == (1, 0, 0, 0, 0, 0, "KKK", digest("system:Be kind.", "user:Hi.", "assistant:Hello!"))
    assert tuple(got[2])[1:] == (1, 0, 1, 1, 2, 4, "KDDK", digest("user:Hi.", "assistant:Yes."))
    assert tuple(got[3])[1:] == (0, 2, 0, 0, 1, 4, "DD", repair.EMPTY)
    assert tuple(got[None])[1:] == (0, 0, 0, 0, 0, 0, "KK", digest("user:Q?", "agent:A. "))
    assert got[4].gaps == 2 and got[4].duplicate == 1 and got[4].audit == "DKKD"
    assert repair.repair(conversations(spark, [])).collect() == []
    none = repair.repair_of_all(conversations(spark, []), conversations(spark, rows[:1]))
    assert [tuple(r) for r in none.collect()] == [(1, 0, 0, 0, 0, 0, 0, "", repair.EMPTY)]


def test_repaired_messages(spark):
    df = conversations(spark, [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")])
    edits = spark.createDataFrame([(1, "KIKK")], "conv_id long, audit string")
    got = [tuple(r) for r in repair.repaired(df, edits).orderBy("place").collect()]
    assert got == [(1, 0, "K", "user", "a."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "b."), (1, 3, "K", "assistant", "c.")]


# ---- 5 leaks


LEAK = "The old baker named Peter sold 12 loaves and 30 rolls to the tall woman from Berlin on a cold day in May"


def test_rows_without_an_id_are_judged_by_their_text(spark):
    rows = [(None, LEAK), (None, "A clean text of its own that holds nothing."), (4, LEAK), (4, "Also clean."), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, raw string")
    bench = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    assert sorted((r.doc_id is None, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(False, 1), (True, 1)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


def test_the_map_of_starts_loses_no_window(spark, monkeypatch):
    """A map that is full, one that is nearly full and the usual one give the same; places are those of all windows."""
    draw = random.Random(8)
    vocabulary = ["the", "of", "Anna", "Paul", "12", "7 km", "3.5", "red", "blue", "House", "and", "walks"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, text(draw.choice([3, 9, 14, 30]))) for k in range(12)]
    rows = [(k, text(10) + " " + (items[k % 12][1] if k % 2 else text(20)) + ". " + text(15)) for k in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for bits in (64, 1 << 10, 1 << 19):
        monkeypatch.setattr(decontaminate, "GATE_BITS", bits)
        found.append(sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())))
    assert found[0] == found[1] == found[2] and {(k, k % 12) for k in range(1, 40, 2)} <= {(f[0], f[1]) for f in found[0]}
