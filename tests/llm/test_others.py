"""Archives, embeddings, tokens, licences, rollups and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataforge.llm import bpe, embedding_dedup, license_scan, shared, token_rollup, warc
from tests.llm import brute
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_warc_query(spark, sf_dir, con):
    assert difference(warc.op1_warc(spark, sf_dir), con, warc.ORACLE) == ""


def test_warc_revisits(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/ x\n", big), (2, None, big), (3, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = warc._qualified(spark, shared.fresh_path(spark, "warc"))
    got = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages, folder), with_payload=True).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes, r.error) for i, r in got.items()} == {
        1: ("revisit", 3, 1800, None), 2: ("revisit", 3, 1800, None), 3: ("response", None, 1800, None), 4: ("response", None, 5, None), 5: ("response", None, 5, None), 6: ("response", None, 0, None), 7: ("response", None, 0, None),
    }
    assert got[3].payload.decode() == big and got[1].payload_digest == got[3].payload_digest


def test_warc_without_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages, warc._qualified(spark, shared.fresh_path(spark, "warc")))).count() == 0


def test_warc_faults():
    archive = warc.Archive(b"WARC/1.1\r\nWARC-Type: response\r\n" * 20)
    raws = [warc.record(i, "u", b"x" * i, None) for i in range(5)]
    for raw in raws:
        archive.add(raw)
    data = b"".join(archive.parts)
    assert list(warc.frames(data)) == raws
    with pytest.raises(warc.BadRecord):
        list(warc.frames(data[:-3]))
    with pytest.raises(warc.BadRecord):
        list(warc.frames(data[8:]))
    with pytest.raises((warc.BadRecord, zstandard.ZstdError)):
        list(warc.frames(data[:-9] + b"garbage!!"))
    for broken in (raws[4][:-1], raws[4].replace(b"WARC-Type", b"Other-Type"), raws[4].replace(b"xxxx", b"xxyx"), b"no header"):
        with pytest.raises(warc.BadRecord):
            warc.parse(broken)


def test_foreign_records(spark, tmp_path):
    """Records of other writers are read, bad ones are rows with ``error``; none stops the job."""
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"

    def made(kind, block, *more, record_id="<urn:uuid:6d05b0b4-5f0a-4a4e-9c8c-1f1c4b1f0b5e>"):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    sha = hashlib.sha1(b"hi").hexdigest()
    raws = [
        made("response", body, http), made("response", body, http, f"WARC-Payload-Digest: sha1:{sha}"), made("warcinfo", b"software: x\r\n"), made("revisit", body[:-2], http),
        made("revisit", body[:-2], http, "WARC-Payload-Digest: sha1:!!!"), made("revisit", body[:-2], http, f"WARC-Payload-Digest: sha1:{sha}", "WARC-Refers-To: <urn:uuid:1>"),
        made("response", body, http, "WARC-Payload-Digest: sha256:abc", record_id="<urn:x-page:7>"), made("poem", b"x"), made("response", body, http, record_id="<urn:x-page:x>"), b"\xff\xfe", made("response", b"\xff", http),
    ]
    archive = warc.Archive(b"WARC/1.0\r\nWARC-Type: response\r\n" * 20)
    for raw in raws:
        archive.add(raw)
        archive.parts.append(struct.pack("<II", 0x184D2A53, 3) + b"abc")
    (tmp_path / "a.warc.zst").write_bytes(b"".join(archive.parts))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.error is None) for r in warc.read_archives(spark, [f"file://{tmp_path}"]).collect()]
    bad = (None, None, None, None, None, False)
    fine = (None, "response", None, 2, sha, True)
    assert got == [fine, fine, (None, "warcinfo", None, 13, hashlib.sha1(b"software: x\r\n").hexdigest(), True), bad, bad, (None, "revisit", None, 2, sha, True), (7, *fine[1:]), bad, fine, bad, bad]


def _vectors(seed=3, n=300, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, width))
    rows = {}
    for i in range(n):
        kind = rng.random()
        v = base[rng.integers(40)] + rng.normal(size=width) * (0.05 if kind < 0.5 else 0.3)
        rows[i] = [float(np.float32(x)) for x in v]
    for i in range(0, 40, 2):
        rows[1000 + i] = rows[i]
    rows |= {2000: None, 2001: [0.0] * width, 2002: [float("nan")] + [1.0] * (width - 1), 2003: [None] + [1.0] * (width - 1), 2004: [float("inf")] + [1.0] * (width - 1), 2005: [], 2006: [1.0, 2.0], 2007: [2.0, 4.0]}
    return rows


def test_embeddings(spark):
    rows = _vectors()
    fine = {i: np.array(v, float) for i, v in rows.items() if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    links = [(a, b) for a in fine for b in fine if a < b and cosine(fine[a], fine[b])]
    label = brute.groups(links, rows)
    number = {i: 0 for i in rows}
    for a, b in links:
        number[a] += 1
        number[b] += 1
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert set(got) == set(rows)
    found = sum(r.n_links for r in got.values()) / sum(number.values())
    assert 0.99 <= found <= 1.0, found
    assert all(r.n_links <= number[i] and r.kept == (r.vec_id == r.component_id) for i, r in got.items())
    assert np.mean([got[i].component_id == label[i] for i in rows]) >= 0.99


def test_embeddings_with_full_borders(spark):
    rows = {i: v for i, v in _vectors(seed=8, n=250, width=24).items() if v and len(v) == 24 and None not in v and all(map(math.isfinite, v)) and any(v)}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items()}
    want = {i: sum(1 for j in rows if i != j and unit[i] @ unit[j] >= 0.95) for i in rows}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    assert {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, guard=None).collect()} == want


def test_embeddings_query(spark, sf_dir, con):
    assert difference(embedding_dedup.op3_embedding_cells(spark, sf_dir), con, embedding_dedup.ORACLE) == ""


def test_no_embeddings(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(5, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.near_vectors(one).collect()] == [(5, 0, 5, True)]


def test_bpe_equals_library(spark):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(1)
    letters = " \n\t\x1c\x85\xa0 　ab'sXtre1½é́ÿµ漢🙂\x00​.,"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "a" * 3000, "ab" * 900, "  \n a  b", "don't", "<|endoftext|>", *(t for t in brute.corpus(2).values())]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert ids.pop(-1) == []
    assert ids == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(bytes(back[i]) == t.encode() for i, t in enumerate(texts))
    # the query's own columns, from the library; rows that repeat an id, or have none, are each by itself
    sha = lambda b: hashlib.sha256(b).hexdigest()
    odd = [(7, "one"), (7, "two words"), (None, "three"), (8, None), (9, ""), *enumerate(texts[:300])]
    rows = bpe.digests(spark.createDataFrame(odd, "doc_id long, text string").withColumn("ids_sha256", F.lit(1)).withColumn("n_tokens", F.lit("x"))).collect()
    want = [(i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in odd for x in [library.encode_ordinary(t or "")]]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.digests(df.limit(0)).count() == 0


def test_bpe_merges_of_random_bytes():
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcde \xc3\xa9\xe6") for _ in range(rng.randint(1, 30))) for _ in range(5000)] + [t for t in bpe.replay(path).token if t] + [b"a" * 999, b"ab" * 500]
    ids, at = bpe.replay(path).encode(words)
    assert all(ids[at[i] : at[i + 1]].tolist() == library._encode_single_piece(w) for i, w in enumerate(words))


def test_licence_sample_is_the_smallest_hashes(spark):
    lines = spark.range(3000).selectExpr("id % 900 as doc_id", "cast(0 as int) as place", "concat('line ', id % 900) as paragraph")
    hashed = lines.distinct().selectExpr("xxhash64(doc_id, place) as h", "doc_id", "paragraph").collect()
    for most in (50, 5000):
        plain = [r["paragraph"] for r in sorted(hashed)[:most]]
        assert sorted(r["paragraph"] for r in license_scan._sample(lines, most).collect()) == sorted(plain)
    assert license_scan._sample(lines.limit(0), 10).count() == 0


def test_licences(spark):
    notices = {1: "Released under the MIT License.", 2: "text\nLicensed under the Apache License, Version 2.0.\nmore", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "All rights reserved.", 6: "the end of the day", 7: None, 8: "", 9: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files, to deal in the Software"}
    plain = {100 + i: t for i, t in brute.corpus(5).items()}
    df = spark.createDataFrame([*notices.items(), *plain.items(), (1, notices[1])], "doc_id long, text string").withColumn("families", F.lit(0))
    found = {}
    for r in license_scan.licence_paragraphs(df).collect():
        found.setdefault(r.doc_id, []).append(r.family)
    assert found == {1: ["mit"], 2: ["apache-2.0"], 3: ["gpl-3.0"], 4: ["cc-by-nc"], 5: ["reserved"], 9: ["mit"]}


#: Notices without any of the words that licences mostly hold.
WORDLESS = {
    1: ("cc-by-sa", "CC-BY-SA 4.0"),
    2: ("mit", "free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
}


def test_notices_without_licence_words(spark, tmp_path):
    """Every line is classified, whatever words it holds; the query's columns count what the operator finds, for any row."""
    rows = [(i, f"the end of the day\n{t}\nand the rest of it") for i, (_, t) in WORDLESS.items()]
    rows += [(3, "Licensed under CC BY-NC 4.0.\nwords between\nLicensed under CC BY-NC 4.0."), (4, "All rights reserved."), (4, "All rights reserved."), (None, "All rights reserved."), (4, "plain words"), (5, None), (6, "")]
    rows += [(7, "plain words of a day\n" * 100_000 + "All rights reserved.")]
    plain = [(200 + i, t) for i, t in brute.corpus(5).items()]
    df = spark.createDataFrame([*rows, *plain], "doc_id long, text string")
    found = license_scan.licence_paragraphs(df).where("doc_id < 100 or doc_id is null").collect()
    assert {r.doc_id: r.family for r in found if r.doc_id in WORDLESS and r.confirmed} == {i: f for i, (f, _) in WORDLESS.items()}
    df.withColumn("families", F.lit(1)).withColumn("place", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op8_licence_classifier(spark, str(tmp_path)).where("doc_id < 100 or doc_id is null").collect()
    text = {(i, f, n) for i, f, n in ((r.doc_id, r.families, r.n_confirmed) for r in got)}
    assert text == {(1, "cc-by-sa", 1), (2, "mit", 1), (3, "cc-by-nc", 2), (4, "reserved", 1), (4, "", 0), (None, "reserved", 1), (5, "", 0), (6, "", 0), (7, "reserved", 1)}
    assert sum(r.families == "reserved" and r.doc_id == 4 for r in got) == 2 and len(got) == len(rows)


UNKNOWN_NOTICES = {
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "boost": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.',
    "eclipse": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "made up": "Permission is granted to redistribute this library under the Fictional Community License, and no warranty of any kind is given by its copyright holders.",
}


def test_notices_of_no_known_family_are_unknown(spark):
    rows = [(10 * i + j, f"the end of the day\n{textwrap.fill(t, w) if w else t}\nand the rest") for i, t in enumerate(UNKNOWN_NOTICES.values()) for j, w in enumerate((0, 75))]
    rows += [(100 + i, t) for i, t in enumerate(["He lost his driving license.", "They had permission to stay, and the warranty was void.", "plain words"])]
    plain = {200 + i: t for i, t in brute.corpus(5).items()}
    found = {}
    for r in license_scan.licence_paragraphs(spark.createDataFrame([*rows, *plain.items()], "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    assert found == {i: {"unknown"} for i, _ in rows if i < 100}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.licence_paragraphs(none).count() == 0


def test_licence_scores_are_the_sums_of_weights(spark):
    texts = [t for _, t in license_scan.TEMPLATES] + [t for _, t in license_scan.OTHERS] + ["no words of the kind", "copyright"]
    assert all(any(w in t.lower() for w in license_scan.WORDS) for t in texts[:-2])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights, intercepts, _ = license_scan.fit(df)
    table = {r.gram: r.weights for r in weights.collect()}

    def plain(text):
        words = ["^", *[w for w in re.split(r"[\W_]+", text.lower()) if w], "$"]
        grams = {" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)} | {w for w in words if w in license_scan.GENERAL}
        s = np.array([b + sum(table[g][c] for g in grams if g in table) for c, b in enumerate(intercepts.values())])
        return list(intercepts)[s.argmax()], 1 / np.exp(s - s.max()).sum()

    grams = license_scan._n_grams(df.withColumnRenamed("text", "paragraph"), "doc_id").distinct().groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    got = {r.doc_id: (r.best, r.p) for r in license_scan._predict(grams, weights, list(intercepts.values()), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        best, p = plain(t)
        assert got[i][0] == best and abs(got[i][1] - p) < 1e-9


LONG_NOTICES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "apache-2.0": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def test_wrapped_licences(spark):
    rows, want = [], {}
    for i, (family, text) in enumerate(LONG_NOTICES.items()):
        for j, (width, mark) in enumerate([(70, ""), (75, " * "), (80, "# "), (30, "")]):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width))
            rows.append((10 * i + j, f"the end of the day\n\n{wrapped}\n\nand the rest of it"))
            want[10 * i + j] = {family}
    both = [textwrap.fill(LONG_NOTICES[f], 75) for f in ("mit", "bsd")]
    rows += [(90, "\n\n".join(both)), (91, "\n".join(both)), (92, f"{both[0]}\nLicensed under CC BY-NC 4.0."), (93, "word\n".join(LONG_NOTICES["mit"].split()[::5]))]
    want |= {90: {"mit", "bsd"}, 91: {"mit", "bsd"}, 92: {"mit", "cc-by-nc"}}
    plain = {100 + i: t for i, t in brute.corpus(5).items()}
    df = spark.createDataFrame([*rows, *plain.items()], "doc_id long, text string")
    found, counts = {}, {}
    for r in license_scan.licence_paragraphs(df).where("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.family)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert found == want
    assert all(counts[i] == len(f) for i, f in want.items())


def test_rollup(spark):
    rows = [(1, "a b", "s", "en"), (2, "a b", "s", "en"), (3, None, "s", None), (4, "c", None, "en")]
    counts = token_rollup.counted(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    rollup = token_rollup.Rollup(spark, shared.fresh_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    for _ in range(3):
        rollup.commit("one", token_rollup.events(counts, 1))
    words = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().where(F.col("tokenizer") == token_rollup.WORDS).collect()}
    assert words() == {("s", "en"): (2, 4, 6), ("s", None): (1, 0, 0), (None, "en"): (1, 1, 1)}
    rollup.commit("two", token_rollup.events(token_rollup.later_copies(counts), -1))
    assert words()[("s", "en")] == (1, 2, 3)
    rollup.commit("three", token_rollup.events(counts.where("doc_id = 4"), -1))
    assert (None, "en") not in words()
    # a writer that is lost before its manifest leaves no trace
    before = words()
    rollup._written(token_rollup.events(counts, 1), "batches")
    assert words() == before
    reader = rollup.manifest()
    rollup.compact()
    assert words() == before and rollup.manifest()["batches"] == {} and len(rollup.manifest()["folded"]) == 3
    with pytest.raises(ValueError):
        rollup.commit("one", token_rollup.events(counts, 1))
    with pytest.raises(RuntimeError):
        rollup._publish(reader | {"version": reader["version"] + 1})
    rollup.commit("four", token_rollup.events(counts.where("doc_id = 4"), 1))
    assert words() == before | {(None, "en"): (1, 1, 1)}


def test_rollup_of_nothing(spark):
    none = token_rollup.counted(spark.createDataFrame([], "doc_id long, text string, source string, lang string"))
    rollup = token_rollup.Rollup(spark, shared.fresh_path(spark, "rollup"))
    rollup.commit("none", token_rollup.events(none, 1))
    assert rollup.totals().count() == 0
    rows = [(1, "a b", "s", "en", 3), (1, "a b", "s", "en", 3), (1, "c", "s", "en", 3), (2, "a b", "s", "en", 3), (None, "a b", "s", "en", 3)]
    counts = token_rollup.counted(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int"))
    assert [r.doc_id for r in token_rollup.later_copies(counts).collect()] == [2]


def test_rollup_query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    toxic, seen, want, ids = set(labels[labels.toxic == 1].doc_id), set(), {}, {}
    library = token_rollup._encoding(public_tokenizers.path(token_rollup.VOCABULARY))
    for r in docs.sort_values("doc_id").itertuples():
        if r.text not in seen:
            seen.add(r.text)
            t = want.setdefault((r.source, r.lang), [0, 0, 0])
            t[0] += 1
            if r.doc_id not in toxic:
                t[1] += len(brute.WORD.findall(r.text))
                t[2] += len(r.text.encode())
                ids[(r.source, r.lang)] = ids.get((r.source, r.lang), 0) + len(library.encode_ordinary(r.text))
    got = token_rollup.op9_token_rollup(spark, sf_dir).collect()
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_bytes] for r in got if r.tokenizer == token_rollup.WORDS} == want
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_bytes] for r in got if r.tokenizer == token_rollup.BYTES} == {k: [t[0], ids.get(k, 0), t[2]] for k, t in want.items()}


def test_pipeline(spark, sf_dir):
    """Every stage against a plain version of it, on what the stage before it kept."""
    import corpus_pipeline
    from strataforge.llm import packing, quality

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    # the learned list is applied by plain code: its conditions on plain counts
    stats = quality.statistics(docs)
    rules = quality.fit(stats, labels)
    features = {r.doc_id: r for r in stats.select("doc_id", *(c.alias(n) for n, c in quality.features().items())).collect()}
    plain = {i: brute.counts(t) for i, t in texts.items()}
    bad = {i for i, c in plain.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
    bad |= {i for i, f in features.items() if any(all(f[n] >= t if up else f[n] <= t for n, up, t in r.tests) for r in rules)}
    kept = {i: t for i, t in texts.items() if i not in bad}
    component = brute.near(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    cut = {i: b.decode("utf-8", "ignore") for i, b in brute.without_repeats(kept).items()}
    cut = {i: t for i, t in cut.items() if t == kept[i] or t.strip(" ")}
    clean = {i: brute.redacted(t) for i, t in cut.items()}
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for i, t in clean.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, len(p), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), packing.CAPACITY)) for p in [ids[at : at + packing.CAPACITY]]]
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    assert sorted(zip(out.doc_id, out.piece, out.length, out.ids_crc32, strict=True)) == sorted(want)
