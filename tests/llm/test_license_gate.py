import random
import re
import re._parser as parser

from tidemark.llm import licenses


def texts_of(pattern):
    """Every text that a rule's pattern matches."""

    def of(parts):
        out = [""]
        for op, arg in parts:
            if str(op) == "LITERAL":
                ways = [chr(arg)]
            elif str(op) == "IN":
                ways = [chr(c) for _, c in arg]
            elif str(op) == "SUBPATTERN":
                ways = of(arg[3])
            elif str(op) == "BRANCH":
                ways = [w for branch in arg[1] for w in of(branch)]
            else:
                assert str(op) == "MAX_REPEAT" and arg[:2] == (0, 1)
                ways = ["", *of(arg[2])]
            out = [o + w for o in out for w in ways]
        return out

    return of(parser.parse(pattern))


def test_every_rule_finds_each_text_of_its_pattern(docs_of):
    texts = [t for _, keyword, pattern in licenses.rules() for t in texts_of(pattern)]
    assert all(keyword in t for _, keyword, pattern in licenses.rules() for t in texts_of(pattern))
    # every rule's first text alone, and its last one between line breaks and underscores
    rows = [w for _, _, pattern in licenses.rules() for t in (texts_of(pattern),) for w in (t[0], "_" + t[-1].upper().replace(" ", " \n") + "_")]
    assert len(texts) > len(rows)
    got = licenses.license_digest(docs_of([(i, t, None, None, None) for i, t in enumerate(rows)])).collect()
    missed = [rows[r["doc_id"]] for r in got if not r["labels"] or r["score"] != 1.0]
    assert not missed


def test_texts_without_a_usual_word_are_scanned(docs_of):
    said = {
        "_CC BY-NC_": "cc-by-nc", "BSD 2-Clause": "bsd-2", "0BSD": "bsd-0", "Apache 2.0": "apache-2", "MPL 2.0": "mpl-2", "CC0 1.0 Universal": "cc0-1",
        "CeCILL": "cecill", "BSL 1.0": "boost-1", "All rights reserved": "proprietary", "in the public \n domain": "public-domain",
        "GPLv3": "gpl-3", "AGPLv3+": "agpl-3", "LGPLv2.1": "lgpl-2.1", "GPLv2 or later": "gpl-2", "MPLv2.0": "mpl-2", "GPL v 2": "gpl-2", "EPL-2.0": "epl-2", "CDDL-1.0": "cddl-1", "EUPL-1.2": "eupl-1.2",
        "Business Source License 1.1": "busl-1.1", "SSPLv1": "sspl-1", "Server Side Public License": "sspl-1", "Elastic License 2.0": "elastic-2", "MIT-0": "mit-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    }
    rows = list(said)
    got = {r["doc_id"]: r for r in licenses.license_digest(docs_of([(i, t, None, None, None) for i, t in enumerate(rows)])).collect()}
    assert {t: got[i]["labels"] for i, t in enumerate(rows)} == said
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (1, 0, 0, "cc-by-nc")


def test_suppression_is_what_all_pairs_say(docs_of):
    """Every detection of every rule, each held against every other."""
    r = random.Random(12)
    known = [(p, re.compile(f"(?<![^ ])(?:{p})(?![^ ])")) for _, _, p in licenses.rules()]
    labels = [label for label, _, _ in licenses.rules()]
    heads = [texts_of(p)[-1] for p, _ in known]
    rows = []
    for i in range(60):
        parts = [r.choice(heads) if r.random() < 0.6 else r.choice(("under the", "licensed", "version 2", "or later", "by nc", "the", "license", "2 0", "x")) for _ in range(r.randint(1, 12))]
        rows.append((i, r.choice((" ", "\n", "-")).join(parts), None, None, None))
    got = {x["doc_id"]: [(d["first"], d["last"], d["label"], d["priority"]) for d in x["detections"]] for x in licenses.scan_licenses(docs_of(rows)).collect()}
    several = 0
    for i, text, *_ in rows:
        flat = re.sub(licenses.BREAK, " ", text.lower()).strip()
        found = [(flat[: m.start()].count(" "), flat[: m.start()].count(" ") + m[0].count(" ") + 1, k) for k, (_, p) in enumerate(known) for m in p.finditer(flat)]
        kept = [d for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]) for e in found)]
        assert sorted(got[i]) == sorted((a, z, labels[k], k) for a, z, k in kept)
        several += len(found) > len(kept) > 1
    assert several > 20
