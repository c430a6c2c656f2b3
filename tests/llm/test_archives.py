"""License scan and WARC archives."""

import gzip
import hashlib
import random
import re
from collections import defaultdict

from lorebase.llm import licenses, warc

PAGES = [
    (3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, "<p>déjà\r\n\r\nWARC/1.1\r\n</p>"), (4, "x\r\ny", None),
    (5, "http://a/5", ""), (6, "http://a/6", "<p>same</p>"), (None, "http://a/n", "<p>null key</p>"), (7, "http://a/7", "z" * 200_000),
    (8, "http://a/8", "twice"), (8, "http://a/8", "twice"),
]


def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, refers_to string").repartition(3)


def test_archive_round_trip(spark):
    got = sorted((tuple(r)[:5] for r in warc.archive_and_read(pages(spark)).collect()), key=str)
    first = defaultdict(list)
    for i, _, html in PAGES:
        first[html or ""].append(i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        least = min((x for x in first[html or ""] if x is not None), default=None)
        kind = "response" if i == least else "revisit"
        want.append((i, len(data), warc.digest(data), kind, None if i == least else least))
    assert got == sorted(want, key=str)
    assert {r.record_type for r in warc.archive_and_read(pages(spark), least=1000).collect()} == {"response"}
    assert warc.archive_and_read(pages(spark).limit(0)).count() == 0


def test_digest_column(spark):
    df = spark.createDataFrame([(t,) for t in ("", "a", "déjà")], "t string").select("t", warc.base32_sha1(warc.F.col("t")).alias("d"))
    assert all(r.d == warc.digest(r.t.encode()) for r in df.collect())
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20


def archive(n, zipped):
    rng = random.Random(n)
    out = []
    for i in range(n):
        payload = rng.randbytes(rng.randint(0, 300)) + b"\r\nWARC/1.1\r\nnot a record\r\n\r\n"
        data = warc.record(i, f"http://h/{i}", payload, warc.digest(payload), None, "2024-01-01T00:00:00Z")
        out.append(gzip.compress(data) if zipped else data)
    return out


def test_salvage_covers_every_byte_and_recovers_later_records():
    for zipped in (False, True):
        for seed in range(30):
            rng = random.Random(seed)
            parts = archive(8, zipped)
            hurt = set(rng.sample(range(8), 3))
            data = b""
            for i, part in enumerate(parts):
                if i in hurt:
                    part = bytearray(part)
                    # plain headers have no digest of their own, so plain damage is put behind them
                    how, at = seed % 3, rng.randrange(20 if zipped else part.find(b"\r\n\r\n") + 4, len(part) - 10)
                    if how == 0:
                        part[at] ^= 0x55
                    elif how == 1:
                        del part[at:]
                    else:
                        part[0:0] = b"garbage \x1f\x8b\x08 WARC/1. garbage"
                data += bytes(part)
            rows = list(warc.salvage(data))
            at = 0
            for offset, length, _, _ in rows:
                assert offset == at
                at += length
            assert at == len(data)
            ids = [int(r.headers["warc-record-id"].strip("<>").removeprefix(warc.PAGE_URN)) for _, _, r, _ in rows if r]
            assert set(range(8)) - hurt <= set(ids) and (seed % 3 == 0 or any(reason for *_, reason in rows))
            assert ids == sorted(set(ids))


def test_gaps_are_logged(spark, tmp_path):
    parts = archive(5, False)
    (tmp_path / "a.warc").write_bytes(parts[0] + parts[1][:-9] + parts[2] + b"tail")
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}", "*.warc").collect()
    gaps = sorted((r.offset, r.length, r.reason) for r in rows if r.kind == "gap")
    assert [r.page_id for r in rows if r.kind == "record"] == [0, 2]
    assert gaps == [(len(parts[0]), len(parts[1]) - 9, "length does not end at a record's end"),
                    (sum(map(len, parts[:3])) - 9, 4, "no version line")]


def test_salvage_is_linear():
    import time

    block = random.Random(4).randbytes(200_000)
    zipped = b"".join(gzip.compress(warc.record(i, "http://a/", block, warc.digest(block), None, "2024-01-01T00:00:00Z"), 1) for i in range(125))
    damaged = {
        b"WARC/1.1\r\n" * 700_000: 0, b"a: WARC/1.0\r\n" * 540_000 + b"\r\n\r\n": 0, b"WARC/1.1\r\na: b\r\n" * 440_000: 0,
        b"WARC/1. x WARC/1.1\r\na: b\r\nz\r\n" * 230_000: 0, b"WARC/1.1\r\nContent-Length: 5\r\nx: WARC/1.0\r\n" * 170_000 + b"\r\nabc": 0, zipped: 125,
    }
    for data, n in damaged.items():
        begin = time.process_time()
        rows = list(warc.salvage(data + zipped[: len(zipped) // 125]))
        assert len(data) > 6_000_000 and sum(1 for *_, r, _ in rows if r) == n + 1
        assert time.process_time() - begin < 8  # a quadratic search takes minutes


def test_version_lines_after_a_failure_are_still_found():
    """A record whose start lies among the failed headers of another one is found if it is whole."""
    body = b"x" * 5
    plain = b"WARC/1.1\r\nContent-Length: 5\r\n\r\n" + body + b"\r\n\r\n"
    wrong = b"WARC/1.1\r\nWARC-Block-Digest: sha1:AAAA\r\nfollowed: by\r\n"
    for lead in (b"WARC/1.1\r\nno colon\r\n", wrong + b"x: ", b"WARC/1.1\r\na: ", b"WARC/1.1\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n", b"WARC/1.\r\n"):
        rows = list(warc.salvage(lead + plain + b"tail"))
        assert sum(length for _, length, _, _ in rows) == len(lead + plain) + 4
        assert [r.block for *_, r, _ in rows if r] == [body], lead


TEXTS = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "MIT License. mit, LICENSE mit licensed"), (3, None), (4, ""),
    (5, "GNU General Public License v3 and SPDX-License-Identifier: MIT"), (None, "The mit\n\nlicense"), (7, "é" * 5 + " 12 words"),
    (7, "é" * 5 + " 12 words"), (8, "word " * 20_000 + "apache license"), (9, "emit license permit licenses"), (10, "Licensed under CC BY-NC 4.0."),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_scan_base_columns_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], "doc_id long, text string, labels string").repartition(2)
    rows = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in rows) == sorted((str(i), *brute(t)) for i, t in TEXTS)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in rows)
    assert licenses.scan(docs.limit(0)).count() == 0


def kept(text):
    return [(r.label, r.name.split("-")[0]) for _, _, r in licenses.detections(text.encode().lower())]


def test_suppression_and_priority():
    assert len(licenses.rules()) > 300
    assert kept("Licensed under the Apache License, Version 2.0.") == [("apache-2.0", "grant")]
    assert kept("the MIT license") == [("mit", "name")]
    assert kept("SPDX-License-Identifier: GPL-3.0-or-later; MIT License") == [("gpl-3.0", "tag"), ("mit", "name")]
    assert kept("https://creativecommons.org/licenses/by-sa/4.0/") == [("cc-by-sa-4.0", "link")]
    assert kept("permit licenses, emit license") == []


# the official spelling of every named rule, in the order of licenses.NAMES
OFFICIAL = (
    "MIT License", "MIT No Attribution", "X11 License", "Apache Software License 1.1", "Apache License, Version 2.0", "BSD 2-Clause License",
    "BSD 3-Clause License", "BSD 4-Clause License", "BSD Zero Clause License", "BSD-style license", "ISC License", "zlib License", "libpng License",
    "Boost Software License 1.0", "The Unlicense", "Do What The Fuck You Want To Public License", "GNU General Public License v1.0",
    "GNU General Public License, version 2", "GNU General Public License v3.0", "GPLv2", "GPLv3", "GNU Library General Public License, version 2.0",
    "GNU Lesser General Public License v2.1", "GNU Lesser General Public License v3.0", "LGPLv2.1", "LGPLv3", "GNU Affero General Public License v3.0",
    "AGPLv3", "GNU Free Documentation License v1.1", "GNU Free Documentation License v1.2", "GNU Free Documentation License v1.3",
    "Mozilla Public License 1.0", "Mozilla Public License 1.1", "Mozilla Public License, v. 2.0", "Eclipse Public License 1.0", "Eclipse Public License - v 2.0",
    "Eclipse Distribution License - v 1.0", "Common Development and Distribution License 1.0", "Common Development and Distribution License 1.1",
    "Common Public License 1.0", "Common Public Attribution License 1.0", "European Union Public Licence 1.1", "European Union Public Licence v. 1.2",
    "Artistic License 1.0", "Artistic License 2.0", "Microsoft Public License", "Microsoft Reciprocal License", "Open Software License 3.0",
    "Academic Free License v3.0", "SIL Open Font License 1.1", "Python Software Foundation License 2.0", "PHP License v3.01", "Ruby License",
    "PostgreSQL License", "OpenSSL License", "Vim License", "University of Illinois/NCSA Open Source License", "Universal Permissive License v1.0",
    "Q Public License 1.0", "LaTeX Project Public License v1.3c", "Business Source License 1.1", "Server Side Public License, v 1",
    "Open Data Commons Open Database License v1.0", "Open Data Commons Attribution License v1.0", "Public Domain Dedication and License 1.0", "CC0 1.0 Universal",
)
TERMS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def official():
    """(label, official spelling) of the named rules, in the order of the rules."""
    yield from zip((n[0] for n in licenses.NAMES), OFFICIAL, strict=True)
    for short, long in TERMS.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            ending = "Generic" if version < "3" else "Unported" if version < "4" else "International"
            yield f"cc-{short}-{version}", f"CC {short.upper()} {version}"
            yield f"cc-{short}-{version}", f"Creative Commons {long} {version} {ending}"


def test_every_named_rule_matches_its_official_spelling():
    for kind, before in (("name", ""), ("grant", "Licensed under the ")):
        rules = [r for r in licenses.rules() if r.name.startswith(kind)]
        for rule, (label, text) in zip(rules, official(), strict=True):
            assert rule.label == label and rule.pattern.fullmatch((before + text).lower().encode()), (rule.name, text)
    for text, label in (("Attribution-NoDerivs 3.0 Unported", "by-nd-3.0"), ("Attribution-NonCommercial-NoDerivs 2.5", "by-nc-nd-2.5"), ("Attribution Share Alike 4.0", "by-sa-4.0")):
        assert kept(f"Creative Commons {text}") == [(f"cc-{label}", "name")]
    for text in ("GPLv3", "GPL v3", "GPL-3", "GPL 3.0", "gpl3", "GNU GPL, version 3"):
        assert kept(text) == [("gpl-3.0", "name")]
    assert kept("GPLv31 xgplv3 gplv3x") == []


def spellings(parsed):
    """One text for every way through the alternatives and options of a parsed expression."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = [" " if str(value[0][0]) == "CATEGORY" else chr(value[0][1])]
        elif name == "SUBPATTERN":
            more = spellings(value[3])
        elif name == "BRANCH":
            more = [x for branch in value[1] for x in spellings(branch)]
        elif name == "MAX_REPEAT":
            more = [""] * (value[0] == 0) + spellings(value[2])
        else:
            assert name in ("ASSERT", "ASSERT_NOT", "AT")
            continue
        out = [a + b for a in out for b in more]
    return out


def test_keyword_lies_in_every_spelling_of_its_rule():
    for rule in licenses.rules():
        # grants repeat the names with their keywords; the Apache notice is only taken in texts that name Apache
        if not rule.name.startswith("grant") and (rule.name[:4], rule.label) != ("text", "apache-2.0"):
            for text in spellings(re._parser.parse(rule.pattern.pattern)):
                assert rule.keyword.decode() in text, (rule.name, text)
    for label, text in official():
        assert [d[0] for d in kept(text)] == [label] and [d[0] for d in kept(f"Licensed under the {text}")] == [label]
    for text in ("GNU Library General Public License version 2", "GNU Library General Public License, v2.0"):
        assert kept(text) == [("lgpl-2.0", "name")] and kept(f"released under the terms of the {text}") == [("lgpl-2.0", "grant")]


def test_containment_equals_brute_force():
    rng = random.Random(3)
    pieces = ["mit license", "licensed under", "the", "gnu general public license", "version 2", "version 2.0", "gpl v3", "apache license", "lesser", "cc by 4.0", "x"]
    for _ in range(300):
        low = " ".join(rng.choice(pieces) for _ in range(12)).encode()
        found = [(m.start(), m.end(), r) for r in licenses.rules() if r.keyword in low for m in r.pattern.finditer(low)]
        found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label, d[2].name))
        taken = []
        for a, b, r in found:
            if not any(x <= a and b <= y for x, y, _ in taken):
                taken.append((a, b, r))
        assert sorted(taken, key=lambda d: (d[0], d[1], d[2].name)) == licenses.detections(low)


_BASE32 = "list_transform(range(0, 8), lambda g: list_transform(range(0, 4), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || h[5 * g + 1:5 * g + 5] AS BIGINT) >> (15 - 5 * k)) % 32 + 1]))"
WARC_SQL = f"""
    WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
    ), named AS (SELECT page_id, n, array_to_string(flatten({_BASE32}), '') AS digest FROM hashed
    ), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM named)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""


def test_archive_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{sf}/pages.parquet'")
    docs = spark.read.parquet(f"{sf}/pages.parquet")
    both = docs.unionByName(docs.withColumn("page_id", docs.page_id + 1000))
    got = sorted((tuple(r)[:5] for r in warc.archive_and_read(both).collect()), key=lambda r: r[0])
    assert got == sorted(con.execute(WARC_SQL).fetchall(), key=lambda r: r[0])
