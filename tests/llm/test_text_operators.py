import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import license_scan, url_filter
from tessella.llm.bpe import Codec, encode
from tessella.llm.common import components
from tessella.llm.histogram_shards import shard_by_bytes
from tessella.llm.positional_index import build_index, contamination, match_near, words
from tessella.llm.simhash_anchors import _links, _near, anchors, fingerprint, near_duplicates, near_links
from tessella.llm.substring_dedup import dedup_substrings

# ---- licences and urls -------------------------------------------------------------------------------------------


def test_licenses(documents, odd, no_documents, with_clashes):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Hello there!\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    docs = documents([(1, mit), (2, "x. Released under the MIT License. Y? Licensed under CC BY-NC 4.0."), (3, "All rights reserved."), (4, "Licensed  under the Apache License,\tVersion 2.0.\nYou may not use this file except in compliance with the License."), (5, "the MIT License released under")])
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(with_clashes(docs, "licenses", "sentence_ids", "n_sentences", "_left", "_l0", "_s", "__left0", "__left1")).collect()}
    assert {(r["_left"], r["_l0"], r["_s"], r["__left0"], r["__left1"]) for r in got.values()} == {("mine",) * 5}
    assert got[1]["licenses"] == ["MIT"] and got[1]["sentence_ids"] == ["MitGrant", "MitNotice", "AsIs"] and got[1]["n_sentences"] == 4
    assert got[2]["licenses"] == ["MIT", "CC-BY-NC-4.0"] and got[3]["leftover_ids"] == ["AllRights"] and got[3]["licenses"] == []
    assert got[4]["licenses"] == ["Apache-2.0"] and got[4]["leftover_ids"] == [] and got[5]["sentence_ids"] == []
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(no_documents).count() == 0
    assert all(r["licenses"] == [] for r in license_scan.scan_licenses(odd).collect())
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


URLS = ["http://a.example.com/en/x", "https://www.EXAMPLE.com/en/1?q", "http://example.com/de/", "http://x.net/es/", "http://net/fr/", "ftp://b.org/", "no scheme", None, "", "http://com", "http://comet/", "http://xnet/es/", "https://example.com/en/#f", "http://com/", "http://.com/", "https://a.b.c.d.www.example.com/en/" + "x" * 5000, "http://example.com:80/en/", "http://h?x://y/en/"]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark, with_clashes):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0]), (99, URLS[0])], "page_id long, url string")
    rules = url_filter.rules_table(spark)
    got = url_filter.judge_urls(with_clashes(pages, "host", "verdict", "u", "key", "best", "bits", "__best", "r_host"), rules).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(r["url"]), r["url"]
    assert {(r["u"], r["best"], r["__best"]) for r in got} == {("mine",) * 3}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    none = url_filter.judge_urls(pages, rules.limit(0))
    assert none.where("rule IS NULL AND verdict = 'allow'").count() == len(got)
    assert url_filter.judge_urls(pages, rules.unionByName(spark.createDataFrame([(None, "/", "block"), ("com", None, "block")], rules.schema))).where("rule = 'com/'").count() > 0


@pytest.mark.parametrize("literal,most", [(4096, 1 << 20), (1, 1 << 20), (1, 1)])
def test_the_filter_drops_most_and_loses_none(spark, monkeypatch, literal, most):
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", literal)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
    listed = spark.range(2000).select(F.concat(F.lit("h"), F.col("id"), F.lit("\n/")).alias("key"))
    assert url_filter.may_hit(listed, listed, 2000).count() == 2000
    assert url_filter.may_hit(spark.range(5000).select(F.concat(F.lit("z"), "id").alias("key")), listed, 2000).count() < 500


def test_a_long_list_is_judged_alike(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", 1)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    more = [(f"h{i}.org", f"/{'p' * (i % 4)}", "block") for i in range(500)]
    got = url_filter.judge_urls(pages, url_filter.rules_table(spark, [*url_filter.RULES, *more])).collect()
    assert len(got) == len(URLS) and all((r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(r["url"]) for r in got)


# ---- byte pairs --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json")).read()
    return Codec(spec), Tokenizer.from_str(spec), public_tokenizers.path("word_bpe_49k.json")


def same(codecs, text):
    own, lib, _ = codecs
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == lib.encode(text, add_special_tokens=False).ids, text
    assert own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abt'hesrlnd 0é.!ßÀ<|>endoftext", max_size=80)))
def test_bpe_is_the_library(codecs, text):
    same(codecs, text)


def test_bpe_odd_texts(codecs):
    for t in ("<|endoftext|>a<|startoftext|> <|END|>", "ΣΑΣ İI ǅ", "é é", "x" * 3000, "abc" * 1500 + "!?" * 900, "don't I'LL we'Re 'S", "\x1c\x85 \u2028z", "日本 ½² ٣ 😀‍💻", "ſK", "<|endoftext|"):
        same(codecs, t)


def test_forced_cuts_change_nothing(codecs):
    own, _, _ = codecs
    words = [b"thqzx", b"internationalization", "naïveté".encode(), b"qqqqzzzz", b"a", b"abcabcabc" * 30, b"aaaaaaaaaaaaa"]
    whole = [own._long([own.single[b] for b in w[:-1]] + [own.single[w[-1] + 256]]) for w in words]
    got, decoded = own.encode_words([w.decode() for w in words])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == whole
    assert [d.decode() for d in decoded] == [own.decode(g) for g in got]
    assert own.cuts(b"qzqz") and not own.cuts(b"the")


def test_bpe_forgets_and_encodes_anew(codecs, monkeypatch):
    from tessella.llm import bpe

    own, lib, path = codecs
    small = Codec(open(path).read())
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "LONG", 3)
    texts = ["the river ran over stones", "the river 東京 ran <|endoftext|> far", None, "x" * 300 + " over", "", "ran over the internationalization"] * 3
    for some in (texts[:4], texts[4:7], texts[7:], texts):
        for t, (ids, decoded) in zip(some, small.encode_texts(some), strict=True):
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded == lib.decode(want, skip_special_tokens=False)
    assert len(small.memory.young[0]) <= 20 and not any(len(w) > 64 for w in small.memory.young[0])


def test_bpe_over_tables(codecs, odd, no_documents, with_clashes):
    own, lib, path = codecs
    got = encode(with_clashes(odd, "token_ids", "other", "_t", "__text", "words"), path).collect()
    assert len(got) == odd.count() and {(r["other"], r["_t"], r["__text"], r["words"]) for r in got} == {("mine",) * 4}
    for r in got:
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == lib.encode(r["text"] or "", add_special_tokens=False).ids
    assert encode(no_documents, path).count() == 0 and "decoded" not in encode(odd, path, decode=False).columns


# ---- near-duplicates ----------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, threshold=2):
    left = {v: v for v in values}
    todo = sorted(left)
    for a in todo:
        for b in todo:
            if a < b and bin(a ^ b).count("1") <= threshold:
                x, y = a, b
                while left[x] != x:
                    x = left[x]
                while left[y] != y:
                    y = left[y]
                left[max(x, y)] = min(x, y)

    def find(v):
        return v if left[v] == v else find(left[v])

    return {v: find(v) for v in values}


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2), st.sampled_from([3, 5, 7]))
def test_linked_fingerprints_meet_at_home(x, flips, length):
    y = x
    for b in flips:
        y ^= 1 << b
    _, where, here = anchors(np.array([y], np.uint64), length)
    _, home, at_home = anchors(np.array([x], np.uint64), length)
    assert home[at_home][0] in where and len(set(where)) == len(where)


def test_comparing_and_looking_up_agree(monkeypatch):
    from tessella.llm import simhash_anchors as S

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20).astype(np.uint64)
    guests = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(7 << 20), base ^ np.uint64(1 << 40)]))
    plain = _links(guests, guests[::2], 2)
    monkeypatch.setattr(S, "LOOK_UP", 1)
    assert (plain == _links(guests, guests[::2], 2)).all() and len(_near(2)) == 64 + 64 * 63 // 2


@pytest.mark.parametrize("piece", [20_000, 40])
def test_links_join_what_brute_force_joins(spark, monkeypatch, piece):
    from tessella.llm import simhash_anchors as S

    monkeypatch.setattr(S, "PIECE", piece)
    rng = np.random.default_rng(3)
    vals = [int(x) for x in rng.integers(0, 2**63, 60)]
    for v in vals[:20]:
        for _ in range(4):
            v ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            vals.append(v)
    hub = vals[0]
    vals = list({*vals, *[hub ^ (1 << b) for b in range(64)]})
    signed = [v - 2**64 if v >= 2**63 else v for v in vals]
    found = components(near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()
    groups = {}
    for v, r in roots(vals).items():
        groups.setdefault(r, set()).add(v - 2**64 if v >= 2**63 else v)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for r in found:
        got.setdefault(r["root"], {r["root"]}).add(r["node"])
    assert {frozenset(g) for g in got.values()} == want


def test_near_duplicates(documents, odd, no_documents, with_clashes):
    assert fingerprint(None) == fingerprint(" ") == 0 and fingerprint("A b") == plain_fingerprint("a B")
    got = near_duplicates(with_clashes(odd, "fp", "component_id", "least")).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert {r["component_id"] for r in got if r["doc_id"] == 9} == {4}
    assert near_duplicates(no_documents).count() == 0
    text = " ".join(f"word{i}" for i in range(400))
    r = {r["doc_id"]: r for r in near_duplicates(documents([(3, text), (1, text.upper()), (2, text + " more")])).collect()}
    assert r[3]["component_id"] == 1 and r[3]["fp"] % 2**64 == plain_fingerprint(text)


def test_components_are_named_by_the_least_of_all_their_documents(documents):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        w = [f"w{i}" for i in rng.integers(0, 5000, 500)]
        for _ in range(8):
            w = list(w)
            w[int(rng.integers(500))] = "other"
            texts.append(" ".join(w))
    ids = [2**60 + int(k) for k in rng.permutation(len(texts))]
    rows = [(None if k % 10 == 3 else i, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))] + [(5, ""), (6, None), (2**60 - 1, texts[0].upper())]
    fps = [plain_fingerprint(t) for _, t in rows]
    root, least = roots(set(fps)), {}
    for (i, _), v in zip(rows, fps, strict=True):
        if i is not None:
            least[root[v]] = min(least.get(root[v], i), i)
    assert len(set(fps)) - len(set(root.values())) > 20
    got = near_duplicates(documents(rows).coalesce(1)).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter((i, v, least.get(root[v])) for (i, _), v in zip(rows, fps, strict=True))


def test_fingerprints_of_bytes_that_are_no_characters(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'FFFE0941E9' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'FFFE2061E9' AS STRING)")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == dict.fromkeys((1, 2), (xxhash.xxh64_intdigest(b"\xff\xfe a\xe9", 42), 1))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[x] == 100 for x in range(101, 160)) and got[201] == 200 and len(got) == 30 + 59 + 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- substrings ---------------------------------------------------------------------------------------------------


def cut_by_hand(rows, span):
    toks = [(i, [w for w in re.split("[ \t-\r]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, w in toks:
        for p in range(len(w) - span + 1):
            key = tuple(w[p : p + span])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in toks:
        gone = set()
        for p in range(len(w) - span + 1):
            if i is not None and first[tuple(w[p : p + span])] < i:
                gone |= set(range(p, p + span))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substrings(documents, odd, no_documents, with_clashes):
    rng = np.random.default_rng(5)
    pas = [" ".join(rng.choice(list("abcdefgh"), 70)) for _ in range(3)]
    same_word = " ".join(["x"] * 200)
    rows = [(k, " ".join([" ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 90)))), pas[k % 3], " ".join(rng.choice(list("ab"), int(rng.integers(0, 60))))])) for k in range(40, 10, -1)]
    rows += [(1, same_word), (2, "y " + same_word), (3, "x " * 49), (50, pas[0] + "\n" + pas[1]), (51, pas[0]), (51, pas[1]), (51, pas[0]), (None, pas[2]), (60, None), (61, "")]
    for span in (50, 12):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_substrings(with_clashes(documents(rows), "n_words", "m", "ranges", "spans", "_th", "_id", "__th", "_cell", "__cell", "__ranges"), span).collect())
        assert got == sorted((i is None, i or 0, n, g, k) for i, n, g, k in cut_by_hand(rows, span))
    got = dedup_substrings(odd).collect()
    assert len(got) == odd.count() and sum(r["n_removed"] for r in got) == 30_000 and {r["spans"][1] for r in got if r["spans"]} == {30_000}
    assert dedup_substrings(no_documents).count() == 0


# ---- shards -------------------------------------------------------------------------------------------------------


def test_shards(spark, documents, odd, no_documents, with_clashes):
    rows = [(i, "t" * (i % 50) + str(i % 700)) for i in range(3000)] + [(i, "the same text") for i in range(5000, 6500)]
    got = shard_by_bytes(with_clashes(documents(rows), "size", "key", "slot")).collect()
    texts = dict(rows)
    size, slots = Counter(), {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(size.values()) / 16
    assert len(got) == len(rows) and len(size) == 16 and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in got:
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    weight = Counter(t for _, t in rows)
    assert all(weight[t] * (len(t) + 1) > 0.02 * mean for t, s in groups.items() if len(s) > 1)  # a border on either side of it would miss by over 1 %
    again = shard_by_bytes(odd).collect()
    assert len(again) == odd.count() and {r["size"] for r in again if r["doc_id"] == 1} == {1}
    one = shard_by_bytes(documents([(7, "same")] * 60)).collect()
    assert len(one) == 60 and max(Counter(r["shard"] for r in one).values()) <= 5
    assert shard_by_bytes(no_documents).count() == 0


# ---- contamination --------------------------------------------------------------------------------------------------


def hits_by_hand(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        if i is None or not x:
            continue
        n = min(13, len(x))
        for o in range(len(x) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[o : o + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_contamination(spark, documents, odd, no_documents, with_clashes, monkeypatch):
    from tessella.llm import positional_index as P

    rng = np.random.default_rng(2)
    gen = lambda n: " ".join(rng.choice(["the", "of", "a", "zed", "quux", "Élan", "x1", "tau"], n))
    items = [(1, gen(30)), (2, "Short Item"), (3, None), (4, "!!!"), (None, gen(20)), (1, gen(15)), (10, gen(13)), (11, "the of")]
    rows = [(k, gen(40) + ", " + (items[0][1] if k % 4 == 0 else items[6][1].replace(" ", "-") if k % 4 == 1 else "short-ITEM!" if k % 4 == 2 else "") + " " + gen(30)) for k in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size, block in ((3_000_000, 8_000_000), (150, 60)):
        monkeypatch.setattr(P, "SEGMENT_WORDS", size)
        monkeypatch.setattr(P, "BLOCK_BYTES", block)
        got = {r["doc_id"]: r for r in contamination(with_clashes(documents(rows), "n_words", "terms"), bench).collect()}
        for i, t in rows:
            n, h, ids = hits_by_hand(t, items)
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"], got[i]["contaminated"]) == (n, h, ids, h > 0 and 20 * h >= n)
    assert contamination(odd, bench).count() == odd.count() and contamination(no_documents, bench).count() == 0
    assert contamination(odd, bench.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_proximity(documents):
    docs = documents([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha q q q q q beta gamma"), (4, None)])
    index = build_index(docs)
    near = {(r["query"], r["doc_id"]) for r in match_near(index, {1: ["alpha", "beta", "gamma"], 2: ["alpha beta"], 3: ["nope"], 4: []}, 2).collect()}
    assert near == {(1, 1), (1, 2), (2, 1), (2, 2)}


FULL_NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}
FULL_NOTICES["BSD-3-Clause"] = FULL_NOTICES["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_full_license_notices(documents):
    names = list(FULL_NOTICES)
    rows = [(i, FULL_NOTICES[n]) for i, n in enumerate(names)] + [(10 + i, "/*\r\n * " + FULL_NOTICES[n].replace("\n", "\r\n * ") + "\r\n */") for i, n in enumerate(names)]
    rows += [(20, "released under\n\nthe MIT license"), (21, "All rights.\nreserved")]
    got = {r["doc_id"]: (r["licenses"], r["leftover_ids"]) for r in license_scan.scan_licenses(documents(rows)).collect()}
    assert all(got[i + k] == ([n], []) for i, n in enumerate(names) for k in (0, 10)) and got[20] == got[21] == ([], [])
