import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import FOLDER, ODD

from spelltally.llm import decontamination, licences, queries, quotations


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j - 1] + (p != t), above[j] + 1, row[j - 1] + 1))
    return min(row)


@pytest.mark.parametrize("text", ["", "x", "the quikc brown fox", "a quick brwn fx there", "nothing alike at all", "aquickbrownfox"])
def test_bit_parallel_distance(text):
    assert decontamination.best_end("quick brown fox", text)[0] == plain_distance("quick brown fox", text)


def test_leaks_with_edits(spark):
    item = "That the erth onesen erblest it hein ti inenan eranenes whou therouou thon the, than heoron."
    edited = item.replace("blest", "blxst").replace("whou ", "whou")
    docs = [(1, f"Before. {item} After."), (2, f"x {edited.upper()} y"), (3, item[:60]), (4, None), (5, "")]
    bench = [(7, item), (8, None), (9, ""), (10, "tiny"), (11, item)]
    hits = decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=150
    ).collect()
    assert sorted((h.doc_id, h.item_id, h.distance) for h in hits) == [(1, 7, 0), (1, 11, 0), (2, 7, 2), (2, 11, 2)]
    assert {docs[0][1][h.start : h.end] for h in hits if h.doc_id == 1} == {item}


def test_leaks_query_against_search(provided, documents, spark):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()
    wanted = {(d, i) for d, t in zip(documents["doc_id"], documents["text"]) for i, b in zip(items["item_id"], items["text"]) if b in t}
    rows = provided("op6_benchmark_leaks")
    assert {(r.doc_id, r.item_id) for r in rows.itertuples() if r.distance == 0} == wanted


def all_distances(item, text):
    """Least edit distance of the item to parts of the text, per end of such a part; rows of the table at once."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for number, char in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != char))
        row = np.minimum.accumulate(np.r_[number, best] - place) + place
    return row[1:]


def test_leaks_against_edit_distances(documents, spark):
    """Every document, and items edited up to and beyond their budget, against every item by the plain table of distances."""
    rng = np.random.default_rng(5)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()
    fold = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    given = list(zip(documents["doc_id"].tolist(), documents["text"]))
    for number, item in enumerate(items["text"]):
        text, budget = list(item), int(len(item) * decontamination.RATE)
        for _ in range(rng.integers(1, budget + 4)):
            place = int(rng.integers(len(text)))
            text[place : place + int(rng.integers(2))] = ["", "q", "zz"][rng.integers(3)]
        given.append((10_000 + number, f"before {''.join(text)} after"))
    # One text with a stretch between documents that costs more than any budget.
    texts = [t.translate(fold) + "\0" * 60 for _, t in given]
    owner = np.repeat([d for d, _ in given], [len(t) for t in texts])
    whole = np.array(list("".join(texts)))
    wanted = {}
    for key, item in zip(items["item_id"], items["text"]):
        item = item.strip().translate(fold)
        distance = all_distances(item, whole)
        near = np.flatnonzero(distance <= int(len(item) * decontamination.RATE))
        for d, n in zip(owner[near].tolist(), distance[near].tolist()):
            wanted[d, key] = min(n, wanted.get((d, key), n))
    rows = decontamination.leaks(spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame(items)).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == wanted
    found = {key for (d, key), n in wanted.items() if d >= 10_000 and n}
    assert 5 < len(found) < len(items)


def test_ids_of_any_type_and_items_that_say_little(spark):
    docs = [(2**53 + 1, "it holds quick-brown foxes, all of them, here"), (None, "ab"), (5, "an ab in prose"), (6, "a 12-letter-it"), (7, "x quick brown"), (8, "squick browns")]
    bench = [("k1", "quick-brown foxes, all of them"), ("k2", "ab"), ("k3", " \t\n"), ("k4", "?!"), (None, "quick brown"), ("k2", "ab")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    for size in (1, 10**6):
        hits = decontamination.leaks(frame, items, block_bytes=size)
        assert hits.schema["item_id"].dataType.simpleString() == "string"
        assert {(h.doc_id, h.item_id) for h in hits.collect()} == {(2**53 + 1, "k1"), (None, "k2")}
        assert sorted(r.doc_id for r in decontamination.clean(frame, items, block_bytes=size).collect()) == [5, 6, 7, 8]
    longer = spark.createDataFrame([(1, "quick brown foxes")], "item_id int, text string")
    prose = spark.createDataFrame([(1, "a Quick Brown Foxes!"), (2, "quick brown foxest"), (3, "quick brown foxes")], "doc_id long, text string")
    assert {h.doc_id for h in decontamination.leaks(prose, longer).collect()} == {1, 3}


def test_repeated_items_and_very_long_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, "word " * 200_000 + item + " word" * 200_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item.replace("six", "sax"))], "item_id long, text string")
    assert {(h.item_id, h.distance, h.start) for h in decontamination.leaks(docs, bench).collect()} == {(1, 0, 10**6), (2, 1, 10**6)}


def test_clean_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert decontamination.clean(odd, bench.limit(0)).count() == len(ODD)
    assert decontamination.leaks(odd, bench.limit(0)).count() == 0
    assert decontamination.leaks(empty, bench).count() == 0


def test_licences_are_inherited_from_the_nearest_folder(spark):
    files = [
        ("a/LICENSE", "Some words before it, many of them, none of a licence.\nReleased under the MIT License."),
        ("a/x.py", "code"), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/y.py", "code"),
        ("a/b/z.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code " * 30),
        ("top.py", None), (None, ""),
    ]
    rows = {r.path: r for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: (r.licence, r.origin) for p, r in rows.items()} == {
        "a/LICENSE": ("MIT", "own"), "a/x.py": ("MIT", "inherited"), "a/b/LICENSE": ("Apache-2.0", "own"),
        "a/b/c/y.py": ("Apache-2.0", "inherited"), "a/b/z.py": ("GPL-3.0", "own"), "top.py": (None, None), "": (None, None),
    }
    assert rows["a/b/c/y.py"].licence_file == "a/b/LICENSE"


def test_licences_query(provided, documents):
    rows = provided("op2_licences")
    wanted = set(documents["doc_id"][documents["text"].str.contains("licen", case=False)])
    assert set(rows["doc_id"][rows["origin"] == "own"]) == wanted and len(rows) == len(documents)


GPL_3 = licences.GPL_HEADER.format("General Public License", 3)
TRIALS = [
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("/*\n * " + GPL_3.replace("modify it ", "modify\n * it ").replace("published by ", "published by\n * ") + "\n */\nint x;", "GPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007", "GPL-3.0"),
    ("Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS", "Apache-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file.', "Apache-2.0"),
    ("Released under the ISC License.", "ISC"),
    ("Released under the Acme Proprietary License.", None),
    ("Released under the Acme License.", None),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", None),
    ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
    (licences.BSD_FORM, "BSD-2-Clause"),
    (licences.BSD_FORM + "\n\n1. x\n\n" + licences.TEMPLATES["BSD-3-Clause"][1], "BSD-3-Clause"),
    (licences.TEMPLATES["MIT"][1], "MIT"),
    ("The licence of this film is not known to me.", None),
]


def plain_scan(files):
    """(licence, origin) by path: cosines over dictionaries of all segments, then a walk up the folders."""
    rows = licences.template_terms(licences.TEMPLATES)

    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    vocabulary = {t for _, _, counts in rows for t in counts}
    held = Counter(t for _, text in files for t in set(words(text or "")) & vocabulary)
    weight = {t: math.log((1 + len(files)) / (1 + held[t])) + 1 for t in vocabulary}
    foreign, own = licences.FOREIGN * max(weight.values()), {}
    for path, text in files:
        text, best = text or "", None
        pieces = re.split(licences.LINE_END, text)
        for paragraph in re.split(licences.PARAGRAPH_END, text):
            pieces += re.split(licences.SENTENCE_END, re.sub(licences.LINE_END, " ", paragraph))
        for place, piece in enumerate(dict.fromkeys(pieces)):
            found = words(piece)
            before = {a for a, b in zip(found, found[1:]) if b in ("licence", "license")} - set(licences.BEFORE)
            vector = {t: n * weight.get(t, foreign) for t, n in Counter(found).items()}
            norm = math.sqrt(sum(w * w for w in vector.values()))
            for name, number, counts in rows:
                if not norm or set(counts) & set(licences.NAMING) != set(found) & set(licences.NAMING) or before - set(counts):
                    continue
                entries = {t: n * weight[t] for t, n in counts.items()}
                cosine = sum(vector.get(t, 0) * e for t, e in entries.items()) / norm / math.sqrt(sum(e * e for e in entries.values()))
                if cosine >= licences.THRESHOLD:
                    option = ((len(counts), round(cosine, 9), -place, -number), name, len(found) / max(1, len(words(text))), cosine)
                    best = max(best or option, option)
        if best:
            own[path] = best
    folders = {}
    for path, (_, name, share, cosine) in own.items():
        folder, _, file = path.rpartition("/")
        if share >= licences.MOSTLY or re.match(licences.LICENCE_NAME, file):
            folders[folder] = max(folders.get(folder, (0.0, "", "")), (round(cosine, 9), path, name))
    result = {}
    for path, _ in files:
        folder = path.rpartition("/")[0]
        while path not in own and folder not in folders and folder:
            folder = folder.rpartition("/")[0]
        result[path] = (own[path][1], "own") if path in own else (folders[folder][2], "inherited") if folder in folders else (None, None)
    return result


def test_licence_names_must_agree(spark):
    frame = spark.createDataFrame([(f"d{i}/x", text) for i, (text, _) in enumerate(TRIALS)], "path string, text string")
    rows = {r.path: r.licence for r in licences.scan(frame).collect()}
    assert [rows[f"d{i}/x"] for i in range(len(TRIALS))] == [name for _, name in TRIALS]


def test_licences_against_plain_cosines_and_walks(provided, documents, spark):
    rng, files = np.random.default_rng(2), []
    for i, text in enumerate([*documents["text"], *(t for t, _ in TRIALS)]):
        folders = [str(x) for x in rng.integers(0, 3, size=rng.integers(0, 4))]
        files.append(("/".join(["top", *folders, f"{'LICENSE' if rng.random() < 0.3 else 'f'}-{i}"]), text))
    rows = {r.path: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert rows == plain_scan(files)
    made = provided("op2_licences")
    assert sorted(made["doc_id"]) == sorted(documents["doc_id"])


def test_the_query_inherits_from_folders_above(spark):
    rows = queries.QUERIES["op2_licences"](spark, "/root/testdata/sf0.01").where("origin = 'inherited'").select("path", "licence_file").collect()
    assert {r.path.count("/") - r.licence_file.count("/") for r in rows} >= {0, 1, 2}


def test_odd_files(spark, empty):
    files = [("a/LICENSE", "Released under the MIT License.", 1), ("a/LICENSE", "Released under the MIT License.", 2), ("a/b", "word " * 100_000, 3), (None, None, 4), ("a/c", "", 5)]
    rows = licences.scan(spark.createDataFrame(files, "path string, text string, cosine int")).collect()
    assert {(r.path, r.licence) for r in rows} == {("a/LICENSE", "MIT"), ("a/b", "MIT"), ("a/c", "MIT"), ("", None)} and len(rows) == 5
    assert licences.scan(empty.selectExpr("source AS path", "text")).count() == 0


def test_a_common_line_makes_no_rows(spark):
    """Terms and cosines stay in a file's row, so a line that all files share costs each of them its own share only."""
    line = "Licensed under the Apache License, Version 2.0."
    files = [(f"d/{i}", f"{line}\nfile {i} of many\n{line}") for i in range(300)] + [("d/other", "no such line"), ("d/0", line)]
    found = licences.statements(spark.createDataFrame(files, "path string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {f"d/{i}" for i in range(300)}
    assert {(r.licence, r.statement, round(r.cosine, 6)) for r in rows.values()} == {("Apache-2.0", line, 1.0)}


def test_quotes_make_threads(spark):
    mails = [
        (1, 0, "Hello all,\n\nshall we meet  on\nMonday?"), (1, 1, "> shall we meet on Monday?\n\nYes."),
        (1, 2, ">> shall we\n>> meet on Monday?\n> Yes.\nAt noon?"), (1, 3, "> nobody said this\nOff topic"),
        (1, 4, None), (2, 0, "> Yes.\nElsewhere"), (None, 7, "> Yes.\nLost"),
    ]
    frame = spark.createDataFrame(mails, "conv_id long, turn long, text string")
    rows = {(r.conv_id, r.turn): r for r in quotations.linked(frame).collect()}
    assert {k: (r.parent_turn, r.thread_turn, r.depth) for k, r in rows.items()} == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (None, 3, 0),
        (1, 4): (None, 4, 0), (2, 0): (None, 0, 0), (None, 7): (None, 7, 0),
    }
    assert rows[1, 2].body == "At noon?" and rows[1, 2].quote_levels == 2
    assert quotations.linked(frame.limit(0)).count() == 0


def test_reply_order_query(provided, spark):
    chats = spark.read.parquet(f"{FOLDER}/conversations.parquet").toPandas()
    rows = chats.merge(provided("op7_reply_order"), on=["conv_id", "turn"])
    assert (rows["text"].str.strip() == rows["body"]).all()
    replies = rows[rows["turn"] > 0]
    assert (replies["parent_turn"] == replies["turn"] - 1).all() and (rows["depth"] == rows["turn"]).all()
