import hashlib
import random
import zlib

import pytest

from murmura.llm import licenses, transport_stream as ts
from murmura.llm.license_texts import NOTICES, TEXTS
from murmura.llm.url_filter import filter_urls, host_scores, propagate

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_read(stream):
    """Packet by packet, for undamaged streams of one program: (payload, [(pts, random_access)])."""
    parts, pmt, data_pid = {}, None, None
    for i in range(0, len(stream), 188):
        p = stream[i : i + 188]
        assert p[0] == 0x47
        pid, start, control = (p[1] & 31) << 8 | p[2], p[1] & 64, p[3] >> 4 & 3
        at, entry = 4, False
        if control & 2:
            entry = p[4] > 0 and bool(p[5] & 64)
            at += 1 + p[4]
        parts.setdefault(pid, []).append((start, entry, p[at:] if control & 1 else b""))
    pat = parts[0][0][2]
    pmt = (pat[11] & 31) << 8 | pat[12]
    table = parts[pmt][0][2]
    data_pid = (table[14] & 31) << 8 | table[15]
    payload, marks, unit = b"", [], b""
    for start, entry, body in [*parts.get(data_pid, []), (True, False, b"")]:
        if start and unit:
            payload += unit[14:]
            t = unit[9:14]
            marks[-1] = ((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1, marks[-1])
            unit = b""
        if start and body:
            marks.append(entry)
        unit += body
    return payload, marks


@pytest.mark.parametrize("size", [0, 1, 160, 161, 162, 163, 164, 345, 346, 347, 16_384, 16_385, 100_000])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    stream = ts.write_stream(payload)
    assert len(stream) % 188 == 0
    found = ts.read_stream(stream)
    assert found["data"] == payload and all(u["complete"] for u in found["units"])
    assert (found["gaps"], found["repeats"], found["errors"], found["lost_bytes"]) == (0, 0, 0, 0)
    assert found["streams"] == [{"program": 1, "pid": 0x100, "type": 6}]
    plain, marks = plain_read(stream)
    assert plain == payload and [(u["pts"], u["random_access"]) for u in found["units"]] == marks


def test_damage_is_found():
    payload = random.Random(1).randbytes(50_000)
    stream = ts.write_stream(payload)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    lost = ts.read_stream(b"".join(packets[:10] + packets[11:]))
    assert lost["gaps"] == 1 and [u["complete"] for u in lost["units"]] == [False, True, True, True]
    again = ts.read_stream(b"".join(packets[:10] + packets[9:]))
    assert again["repeats"] == 1 and again["data"] == payload
    shifted = ts.read_stream(b"junk" + stream + b"tail")
    assert shifted["data"] == payload and shifted["lost_bytes"] == 8
    flagged = ts.read_stream(b"".join([*packets[:10], bytes([0x47, packets[10][1] | 0x80]) + packets[10][2:], *packets[11:]]))
    assert flagged["errors"] == 1 and flagged["gaps"] == 1
    for foreign in (b"", b"x", b"G" * 1000, bytes(5000)):
        assert ts.read_stream(foreign)["units"] == []
    bad_table = ts.read_stream(stream[:20] + b"\x01" + stream[21:188])
    assert bad_table["streams"] == []


def test_counters_and_timestamps_wrap():
    stream = ts.write_stream(bytes(500_000))
    assert ts.read_stream(stream)["gaps"] == 0
    assert ts._ticks(ts._timestamp(2, (1 << 33) + 5)) == 5


def test_media_of_awkward_rows(awkward, no_rows):
    rows = ts.read(ts.store(awkward, keep=("doc_id", "text")), keep=("doc_id", "text")).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        text = (r.text or "").encode()
        assert len(r.data) % 64 == 0 and len(r.data) >= 64 and r.data.rstrip(b"\x00") == text.rstrip(b"\x00")
    assert ts.read(ts.store(no_rows)).collect() == []


def test_media_query(spark, awkward, tmp_path):
    from murmura.llm.queries import op2_transport_stream

    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op2_transport_stream(spark, str(tmp_path)).collect():
        source = awkward.where(awkward.doc_id.eqNullSafe(r.doc_id)).first()
        payload = ts.pad((source.text or "").encode())
        media = ts.write_stream(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.n_bytes) == (len(media), hashlib.sha256(media).hexdigest(), len((source.text or "").encode()))


def test_license_forms(spark):
    mit = TEXTS["MIT"]
    docs = [
        (1, "MIT License\n\nCopyright (c) 2022 Somebody\nAll rights reserved.\n\n" + mit),
        (2, mit.upper().replace('"', "“").replace(",", " ,").replace("\n", "\r\n")),
        (3, "© 2001 A\n" + mit.replace("sublicense", "sublicence")),
        (4, mit + "and more"),
        (5, None),
        (6, ""),
        (7, "text\nLicensed under the Apache Licence, version 2.0\nmore\nReleased under the MIT License.\n"),
        (7, "text\nLicensed under the Apache Licence, version 2.0\nmore\nReleased under the MIT License.\n"),
        (None, "We have a copyright notice. Licensed under Apache."),
    ]
    rows = [(r.doc_id, r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, "MIT titled", ""), (2, "MIT", ""), (3, "MIT", ""), (4, None, ""), (5, None, ""), (6, None, ""), (7, None, "Apache-2.0,MIT"), (7, None, "Apache-2.0,MIT"), (None, None, "")], key=str
    )


def test_all_known_licenses_find_themselves(spark, no_rows, awkward):
    docs = spark.createDataFrame([(i, k, f"Copyright 2020 X\n{v}") for i, (k, v) in enumerate(TEXTS.items())], "doc_id long, name string, text string")
    names = {i: k for i, k in enumerate(TEXTS)}
    for r in licenses.scan(docs).collect():
        assert r.license_id == names[r.doc_id]
    assert all("licen" in v.lower() or "spdx" in v.lower() for v in NOTICES.values())
    assert licenses.scan(no_rows).collect() == []
    assert licenses.scan(awkward).count() == awkward.count()


def brute_scores(links, seeds, damping, rounds):
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    scores = dict(seeds)
    for _ in range(rounds):
        after = dict(seeds)
        for a, targets in out.items():
            for b in targets:
                after[b] = after.get(b, 0) + damping * scores.get(a, 0) / len(targets)
        scores = after
    return scores


def page(host, *targets, path="/x"):
    return f"https://{host}{path}", "".join(f'<a href="https://{t}/y">t</a>' for t in targets)


def test_links_carry_trust_and_distrust(spark):
    web = [
        page("good.org", "a.example", path="/fr/1"),
        page("a.example", "b.example"),
        page("bad.net", "a.example"),
        page("spam.example", "bad.net", "worse.net", "bad.net"),
        page("spam2.example", "spam.example"),
        page("worse.net"),
        page("mixed.example", "bad.net", "a.example", "b.example", "good.org"),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(web)], "page_id long, url string, html string")
    rows = {r.host: r for r in filter_urls(pages, RULES, threshold=0.5, rounds=30).collect()}
    links = [("good.org", "a.example"), ("a.example", "b.example"), ("bad.net", "a.example"), ("spam.example", "bad.net"), ("spam.example", "bad.net"), ("spam.example", "worse.net"), ("spam2.example", "spam.example"), *[("mixed.example", x) for x in ("bad.net", "a.example", "b.example", "good.org")]]
    trust = brute_scores(links, {"good.org": 1.0}, 0.85, 30)
    distrust = brute_scores([(b, a) for a, b in links], {"bad.net": 1.0, "worse.net": 1.0}, 0.85, 30)
    for host, r in rows.items():
        assert r.trust == pytest.approx(trust.get(host, 0)) and r.distrust == pytest.approx(distrust.get(host, 0))
    verdicts = {h: r.verdict for h, r in rows.items()}
    assert verdicts["spam.example"] == "block" and verdicts["a.example"] == "allow" and verdicts["mixed.example"] == "allow"


def test_any_web_equals_brute_force_and_sql(spark, tmp_path):
    """Cycles, hosts that link nowhere, links to hosts without pages, a hub, many links of one kind; in DuckDB too."""
    import duckdb

    from murmura.llm import queries

    r = random.Random(12)
    hosts = [f"h{i}.example" for i in range(12)] + ["a.net", "b.net", "c.org", "hub.example"]
    links = {h: [r.choice(hosts) for _ in range(r.choice([0, 1, 3]))] for h in hosts}
    links["h0.example"], links["h1.example"], links["h2.example"] = ["h1.example"], ["h2.example"], ["h0.example", "a.net"]  # a cycle that leads to a blocked host
    links["hub.example"] = ["a.net"] * 20_000 + ["nowhere.example"] * 300
    web = [page(h, *links[h], path="/fr/1" if h == "c.org" else "/x") for h in hosts]
    web += [page("half.example", "b.net"), (None, web[0][1]), ("no url", "<a href='//a.net'>"), ("https://half.example/2", None)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(web)], "page_id long, url string, html string")
    rows = filter_urls(pages, queries.URL_RULES, threshold=0.5, damping=0.85, rounds=20).collect()
    flat = [(h, t) for h in hosts for t in links[h] if t != h] + [("half.example", "b.net")]
    trust, distrust = brute_scores(flat, {"c.org": 1.0}, 0.85, 20), brute_scores([(b, a) for a, b in flat], {"a.net": 1.0, "b.net": 1.0}, 0.85, 20)
    for x in rows:
        assert x.trust == pytest.approx(trust.get(x.host, 0)) and x.distrust == pytest.approx(distrust.get(x.host, 0)), x.host
    assert len({x.verdict for x in rows if x.rule is None}) == 2
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
        found = con.sql(queries.ORACLE_SQL["op10_url_filter"]).fetchall()
    assert sorted(found) == sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in rows)


def test_a_score_at_the_threshold_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://s.example/de/1", None), (2, "http://s.example/x", None)], "page_id long, url string, html string")
    rules = [("s.example/de/", "block")]  # half of the host's pages
    verdict = lambda t: {x.page_id: x.verdict for x in filter_urls(pages, rules, threshold=t).collect()}[2]
    assert verdict(0.5) == "allow" and verdict(0.49) == "block"


def test_very_long_pages_and_urls(spark):
    long_url, long_page = "http://x.example/" + "a" * 200_000, "<p>" + "word " * 200_000 + '<a href="http://b.net/">'
    pages = spark.createDataFrame([(1, long_url, long_page), (2, "http://b.net/", None)], "page_id long, url string, html string")
    rows = {x.page_id: x for x in filter_urls(pages, RULES, threshold=0.5).collect()}
    assert len(rows[1].path) == 200_001 and rows[1].verdict == "block" and rows[2].rule == "net/"


def test_rules_and_urls(spark):
    urls = [
        ("http://x.net/a", "x.net", "/a", "net/", "block"), ("http://net/a", "net", "/a", "net/", "block"), ("http://xnet/a", "xnet", "/a", None, "allow"),
        ("http://M.Example.NET/en/1?q#f", "m.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"), ("x://a.org/fr/?://b.net/", "a.org", "/fr/", "org/fr/", "allow"), ("no url", "", "", None, "allow"),
        ("://", "", "", None, "allow"), ("http://?q", "", "", None, "allow"), ("http://h#f/x", "h", "", None, "allow"), (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, RULES).collect()}
    assert rows == {i: u[1:] for i, u in enumerate(urls)}
    assert filter_urls(pages.where("page_id < 0"), RULES).collect() == []
    assert filter_urls(pages.union(pages), RULES).count() == 2 * len(urls)
    assert {r.rule for r in filter_urls(pages, []).collect()} == {None}


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, *page("a.example", "b.net"))], "page_id long, url string, html string")
    plan = filter_urls(pages, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_scores_stop_when_they_settle(spark):
    edges = spark.createDataFrame([("trust", "a", "b", 1.0)], "kind string, source string, target string, share double")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    assert {(r.host, r.score) for r in propagate(edges, seeds, 0.5, 50).collect()} == {("a", 1.0), ("b", 0.5)}
    empty = spark.createDataFrame([], "host string, verdict string, html string")
    assert host_scores(empty).collect() == []


def test_notices_without_the_word_license(spark):
    given = {"PD": "This work is in the public domain.", "CC0": "CC0 1.0", "MIT": NOTICES["MIT"], "author": "By the owner", "日本": "著作権なし"}
    texts = {1: "x\nThis WORK is in the public domain", 2: "a\ncc0, 1.0\nb", 3: "Released under the MIT licence", 4: "by the HOLDER", 5: "nothing", 6: "著作権なし!", 7: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {1: "PD", 2: "CC0", 3: "MIT", 4: "author", 5: "", 6: "日本", 7: ""}
    assert {r.doc_id: r.notices for r in licenses.scan(docs, notices=given).collect()} == want
    del given["日本"]
    assert {r.doc_id: r.notices for r in licenses.scan(docs, notices=given).collect()} == want | {6: ""}
    assert licenses.needles([" license a ", " licensed b "]) == ["licence", "license"] and licenses.needles(["  "]) is None
    assert licenses.scan(docs, notices={}).where("notices <> ''").count() == 0


def test_licenses_from_a_folder(spark, tmp_path):
    (tmp_path / "GPL-x.txt").write_text("General Licence,\nversion X.  Copyright (c) 2001 Someone\nYou may copy.")
    (tmp_path / "Copy-of-it").write_text("GENERAL license version x\nyou may copy")
    (tmp_path / "Other").write_text("Another text\nof two lines")
    table = licenses.load(spark, str(tmp_path))
    assert table.count() == table.select("digest").distinct().count() and {"GPL-x", "Copy-of-it"} & {r.license_id for r in table.collect()}
    docs = spark.createDataFrame([(1, "general license; version X. Copyright 2020 Z\n\nYou may copy!"), (2, "another TEXT of two lines."), (3, TEXTS["MIT"]), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses=table).collect()}
    assert found[2] == "Other" and found[3] == "MIT" and found[4] is None


def test_license_of_very_long_text(spark):
    long_text = "\n".join(["just a line of words"] * 50_000 + ["SPDX-License-Identifier: MIT"])
    row = licenses.scan(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).first()
    assert row.license_id is None and row.notices in {"", *NOTICES}


def test_whole_public_licenses_are_known(spark):
    whole = {k: v for k, v in licenses.TEXTS.items() if len(v) > 5_000}
    assert {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(whole)
    rows = [(i, "Copyright (c) 2020 Somebody\n" + v.upper().replace("\n", "\r\n").replace(", ", " , ")) for i, v in enumerate(whole.values())] + [(99, whole["GPL-3.0"] + " more")]
    found = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(whole)) | {99: None}


def test_kept_columns_that_clash_are_refused(spark, awkward):
    from murmura.llm import bpe, language, packing, quality, token_counts, transport_stream

    named = lambda c: awkward.withColumnRenamed("lang", c)
    for call in (
        lambda: transport_stream.store(named("media"), keep=("media",)), lambda: transport_stream.read(named("units"), keep=("units",)), lambda: quality.quality(awkward, None, keep=("kept",)), lambda: language.identify(awkward, None, keep=("score",)),
        lambda: bpe.encode(named("ids"), "", keep=("ids",)), lambda: bpe.decode(named("decoded"), "", keep=("decoded",)), lambda: token_counts.token_counts(named("n_words"), "", keep=("n_words",)), lambda: packing.pack(named("rank"), 8),
    ):
        with pytest.raises(ValueError, match="must not be called"):
            call()
