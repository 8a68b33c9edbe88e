"""Distinctive terms, documented functions, provenance of files, personal data."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import distinctive, functions, personal, provenance

T0 = dt.datetime(2025, 1, 1)


def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, tokens array<string>, term string")


def test_top_terms_against_brute_force(spark, rows):
    data = {"a": [" X ", "x", "y", "", None, "z"], "b": ["x", "y", "y"], "c": ["z", "Z", "q"], "d": [], "e": ["only"], "f": None}
    df = entries(spark, [(i, t, "t") for i, t in data.items()] + [("a", data["a"], "t"), (None, ["x"], "t")])
    clean = {i: Counter(w.strip().lower() for w in t if w and w.strip()) for i, t in data.items() if t is not None}
    d = Counter(w for c in clean.values() for w in c)
    want = {}
    for i, c in clean.items():
        best = sorted((-n * math.log2((len(clean) + 1) / d[w]), w) for w, n in c.items() if d[w] >= 2)
        if best:
            want[i] = best[0][1]
    assert dict(rows(distinctive.top_terms(df))) == want
    assert distinctive.top_terms(df.limit(0)).collect() == []


def test_two_poisson_separates():
    counts, freq = np.array([[0, 1, 2, 8, 9, 10]], float), np.array([[900, 60, 10, 8, 12, 10]], float)
    share, high, low = distinctive.fit_two_poisson(counts, freq)
    assert 5 < high[0] < 12 and low[0] < 0.5 and 0.01 < share[0] < 0.1
    post = distinctive.elite_posterior(counts[0], share[0], high[0], low[0])
    assert post[0] < 0.01 and post[-1] > 0.99 and (np.diff(post) >= 0).all()


def test_posterior_in_range(spark):
    df = entries(spark, [(f"r{i}", ["common"] * (1 + i % 2) + (["rare"] * 6 if i % 9 == 0 else []), "") for i in range(60)])
    got = {(r["id"], r["term"]): r for r in distinctive.score_terms(df).collect()}
    assert all(0 <= r["posterior"] <= 1 for r in got.values()) and got["r0", "rare"]["d"] == 7


TRIVIAL = ["//", "/** */", '"""..."""', "# TODO", "N/A", "待补充", "<p></p>", "=====", "@param x the x\n@return y", "{@inheritDoc}", "/**\n * Gets the user name.\n */", "// License: see LICENSE", "Copyright 2020 A. All rights reserved.", "This method gets user names", "Auto-generated method stub"]
REAL = ["/** Retries twice before giving up. */", "TODO rename. Falls back to the cache.", "# 如果不存在则回退到本地缓存", "Gets the user name from the nearest replica.", "@param x\nReads ahead of the cursor."]


@pytest.mark.parametrize("text", TRIVIAL)
def test_trivial(text):
    assert functions.is_trivial(text, "getUserName")


@pytest.mark.parametrize("text", REAL)
def test_not_trivial(text):
    assert not functions.is_trivial(text, "getUserName")


def test_extract_functions():
    py = "class A:\n    # above\n    @dec\n    def f(self,\n          x=1):\n        return {\n  1: 2}\n\n    def g(self):\n        '''Doc of g.'''\n        pass\nx = 1\n"
    got = {f[0]: f for f in functions.extract_functions(py, "python")}
    assert got["f"][5].strip() == "# above" and got["g"][5] == "'''Doc of g.'''" and "x = 1\n" not in got["g"][4] and got["g"][1] == 9
    go = "// Runs it.\nfunc (s *S) Run(x int) error {\n\ts := \"}\" // }\n\tif x { return nil }\n}\n\n// far\n\n\nfunc Next() {}\n"
    got = {f[0]: f for f in functions.extract_functions(go, "go")}
    assert got["Run"][4].endswith("return nil }\n}") and got["Run"][5] == "// Runs it." and got["Next"][5] is None
    ruby = "# Doc.\ndef a(x)\n  if x\n    1\n  end\nend\ndef b; end\n"
    assert [(f[0], f[2]) for f in functions.extract_functions(ruby, "ruby")] == [("a", 6), ("b", 7)]


def test_documented_methods(spark, rows):
    late = T0 + dt.timedelta(days=1)
    code = "int run() {\n  return 1;\n}"
    df = spark.createDataFrame([
        (1, "run", "Retries twice.", None, code, T0, "x"), (1, "run", "Retries twice.", None, code, T0, "x"), (2, "run", "//", None, "// Real words here\n" + code, T0, "x"),
        (3, "run", None, None, "/* Real words here */\n" + code, T0, "x"), (4, "run", "  ", None, "def run(self):\n    \"\"\"Waits for locks.\"\"\"\n    return 1\n", T0, "x"),
        (5, "run", "Real words", None, "  ", T0, "x"), (6, "run", "Real words", None, None, T0, "x"), (7, None, "Real words", None, code, None, "x"),
        (8, "run", "Real words", None, code, T0, "x"), (8, "run", "runs", None, code, late, "x"), (None, "run", "Real words", None, code, T0, "x"), (9, "run", None, None, code, T0, "x"),
    ], "id bigint, name string, doc_comment string, signature string, source string, indexed_at timestamp, doc string")
    assert rows(functions.documented_methods(df)) == [(1,), (3,), (4,), (7,)]
    pairs = {r["method_id"]: r for r in functions.method_pairs(df).collect()}
    assert set(pairs) == {1, 3, 4, 7} and pairs[3]["code"] == code and pairs[3]["description"] == "Real words here" and pairs[3]["signature"] == "int run()"
    assert functions.documented_methods(df.limit(0)).collect() == []


def sources(n=30):
    made = "package a\n" + "".join(f"type F{i} struct {{ F{i}_id string `json:\"f{i}\"` }}\nfunc (x *F{i}) GetF{i}() string {{ return x.F{i}_id }}\n" for i in range(30))
    hand = "package a\n\n// Waits for the lock before it reads the rows that a writer has marked.\nfunc (s *Store) Read{0}(name string) error {{\n\tif name == \"\" {{\n\t\treturn errors.New(\"empty name\")\n\t}}\n\tfor _, row := range s.rows {{\n\t\tif row.dirty && !s.locked[name] {{\n\t\t\ts.wait(row.key, timeout)\n\t\t}}\n\t}}\n\treturn s.flush{0}()\n}}\n"
    rows = [(i, f"/repos/r/a{i}.go", "// Code generated by tool. DO NOT EDIT.\n" + made.replace("F", "Field"[: i % 6] + "G" * (i % 3) or "F").replace("range(30)", "")) for i in range(n)]
    rows += [(100 + i, f"/repos/r/b{i}.go", hand.format(chr(65 + i % 26) * 3) * (1 + i % 3)) for i in range(n)]
    rows += [(200, "/repos/r/c.go", made), (201, "/repos/r/third_party/lib/x.go", hand.format("Q")), (202, "/repos/r/d.go", "// Checks that generated code says DO NOT EDIT\n" + hand.format("Z")),
             (203, "/repos/r/vendor_portal/x.go", hand.format("V")), (204, "/repos/r/e.go", "// Taken verbatim from lib 1.2.3 (licence)\n" + hand.format("T")), (205, "/repos/r/f.go", None), (206, "/repos/r/g.go", " "), (207, None, hand.format("N"))]
    return rows


def test_foreign_files(spark, rows):
    data = sources()
    files = spark.createDataFrame([(i, p, T0, "x") for i, p, _ in data], "id bigint, absolute_path string, indexed_at timestamp, label string")
    texts = spark.createDataFrame([(i, t) for i, _, t in data], "file_id bigint, content string")
    found = {r[0] for r in rows(provenance.foreign_files(files, texts))}
    assert found == {*range(30), 200, 201, 204}
    few = texts.where("file_id in (0, 201, 203)")
    assert {r[0] for r in rows(provenance.foreign_files(files, few))} == {0, 201}
    assert provenance.foreign_files(files, texts.limit(0)).collect() == []


@pytest.mark.parametrize("line", ["// Vendor onboarding: every third party gets one voucher.", "// Checks that the generated code carries its DO NOT EDIT mark", "// Part of the nightly job", "# Licensed to the maintainers of this repository."])
def test_no_notice(line):
    assert not provenance.TOOL_NOTICE.search(line) and not provenance.COPY_NOTICE.search(line)


def test_headings_are_hidden_from_measures():
    body = "package a\nvar x = 1\n"
    assert provenance.measure("// Code generated by x. DO NOT EDIT.\n" + body) == provenance.measure(body)
    assert len(provenance.measure("")) == len(provenance.FEATURES)


FOUND = [
    ("mail maren@mail.example now", {("email", "maren@mail.example")}), ("[m](mailto:A.B+c@X.ORG)", {("email", "A.B+c@X.ORG")}), ("cc a dot b at mail dot example,", {("email", "a dot b at mail dot example")}),
    ("x(at)mail.example", {("email", "x(at)mail.example")}), ("y [at] mail [dot] example", {("email", "y [at] mail [dot] example")}), ("remote git@forge.example:a/b.git @v/kit@7.4.1 m[6] @ w[7]", set()),
    ("Tel. +49 (0)30/23125-420; x", {("phone", "+49 (0)30/23125-420")}), ("call (264) 555-0164 before", {("phone", "(264) 555-0164")}), ("mobile 020 7946 0880 (evenings)", {("phone", "020 7946 0880")}),
    ("build 2025-0555-0181 ticket 555-0192-B v1.555.0114 part no. 924-24-3337", set()), ("SSN: 938712833 -", {("id_number", "938712833")}), ("NIR : 9 94 13 16 816 913 99;", {("id_number", "9 94 13 16 816 913 99")}),
    ("passport no X0D894916 attached", {("id_number", "X0D894916")}), ("Ship to: 53 avenue du Vieux Port, 09033 Grauenfels;", {("address", "53 avenue du Vieux Port, 09033 Grauenfels")}),
    ("from Flat 12, 38 Mill Road on Fridays", {("address", "Flat 12, 38 Mill Road")}), ("Anschrift: Hafenstr. 21.", {("address", "Hafenstr. 21")}), ("Step 15 Release Lane only starts", set()),
    ("Reviewed-by: Falk Estmoor;", {("name", "Falk Estmoor")}), ("As Dr. Brandermoor, Tilde pointed out, x", {("name", "Brandermoor, Tilde")}), ("thanks to anselm kovanthe for the trace", {("name", "anselm kovanthe")}),
    ("TODO(A. Kovanthe): x", {("name", "A. Kovanthe")}), ("Blue Harbor is the code name. Order Router and Hash Ring share", set()),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_personal_cases(text, want):
    find = personal.Detector({"Falk": "given", "Estmoor": "family", "Tilde": "given"}).find
    assert {(k, text[s:e]) for s, e, k in find(text)} == want


def test_replacements():
    text = "Reviewed-by: Maren Tolvik. As Dr. Tolvik, Maren pointed out: REVIEWER ELOWEN KOVANTHE - call +1 327 555 0127 or +1 327 555 0199, a@b.example"
    cases = personal.Detector({}).find(text)
    marked = personal.replace_cases(text, cases, b"k")
    tags = [w for w in marked.replace(".", " ").replace(",", " ").split() if w.startswith("[NAME_")]
    assert len(tags) == 3 and tags[0] == tags[1] != tags[2] and "[PHONE_" in marked and "[EMAIL_" in marked
    fake = personal.replace_cases(text, cases, b"k", "surrogate")
    assert fake != text and "Tolvik" not in fake and "+1 " in fake and fake.count("@b.example") == 1
    assert fake == personal.replace_cases(text, cases, b"k", "surrogate") != personal.replace_cases(text, cases, b"other", "surrogate")
    values = [f"user{i}@mail.example" for i in range(200)]
    many = " ".join(values)
    replaced = personal.replace_cases(many, personal.Detector({}).find(many), b"k").split()
    assert len(set(replaced)) == 200 == len(replaced)


def test_personal_operator(spark, rows):
    docs = spark.createDataFrame([(1, "mail a@b.example and a@b.example", "x"), (2, None, "x"), (3, "", "x"), (4, "plain " * 20_000, "x")], "doc_id bigint, text string, value string")
    names = spark.createDataFrame([("Maren", "given"), (None, "family"), ("x", None)], "token string, role string")
    assert rows(personal.personal_cases(docs, names)) == [(1, "email", "a@b.example")]
    out = {r["doc_id"]: r for r in personal.redact_documents(docs, names).collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and out[1]["cases"] == 2 and "a@b" not in out[1]["text"]
    assert personal.personal_cases(docs.limit(0), names).collect() == []


def fakes(kind, values, key=b"k"):
    return [personal.replace_cases(v, [(0, len(v), kind)], key, "surrogate") for v in values]


def test_surrogates_of_many_values_differ():
    names = [f"{g} {f}" for g in ("Marena", "Anselm", "M.", "A.", "Anselm B.", "Anselm C.") for f in (f"Tolv{chr(97 + i // 26)}{chr(97 + i % 26)}k" for i in range(500))]
    phones = [f"+1 327 555 {i:04d}" for i in range(3000)] + [f"0{i:04d} 1234" for i in range(3000)]
    places = [f"{i} Mill{chr(97 + i % 26)} Road, {i % 7}1000 Grauen" for i in range(1000)]
    for kind, values in {"name": names, "phone": phones, "address": places, "email": [f"u{i}@b.example" for i in range(3000)], "id_number": [f"X{i:07d}" for i in range(3000)]}.items():
        made = fakes(kind, values)
        assert len({personal.normal_form(kind, v) for v in made}) == len(values) and not set(made) & set(values), kind


def test_surrogates_are_the_same_in_every_text():
    names = [f"Anselm Tolv{chr(97 + i // 26)}{chr(97 + i % 26)}k" for i in range(600)]
    text, cases = "", []
    for n in names:
        cases.append((len(text), len(text) + len(n), "name"))
        text += n + ";"
    assert personal.replace_cases(text, cases, b"k", "surrogate")[:-1].split(";") == fakes("name", names)
    digits = {personal.normal_form("phone", v) for v in fakes("phone", ["+49 (0)30/23125-420", "+49 030 23125 420", "+4903023125420"])}
    assert len(digits) == 1
    assert fakes("name", ["Tolvik, Marena"])[0].split(", ")[::-1] == fakes("name", ["Marena Tolvik"])[0].split(" ")


@pytest.mark.parametrize(("value", "kept", "gone"), [
    ("53 avenue du Vieux Port, 09033 Grauenfels", ["avenue du"], ["Vieux", "Port", "Grauenfels", "09033"]), ("Flat 12, 38 Mill Road", ["Flat", "Road"], ["Mill"]),
    ("Hafenstr. 21", ["str. "], ["Hafen"]), ("Am Alten Weg 3, 12345 Bad-Stadt", ["Am ", "weg"], ["Stadt", "12345"]), ("Calle de la Luna, 7", ["Calle de la "], ["Luna"]), ("12 Court Road", ["Road"], ["Court"]), ("Am Ring 4", ["Am ", "ring "], ["Am Ring"]),
])
def test_street_and_town_are_invented(value, kept, gone):
    made = fakes("address", [value])[0]
    assert all(k.lower() in made.lower() for k in kept) and not any(g.lower() in made.lower() for g in gone)


def test_elite_terms_against_the_mixture(spark):
    rng = np.random.default_rng(5)
    entries = {f"e{i}": ["common"] * int(rng.poisson(2)) + ["topic"] * int(rng.poisson(6 if i % 4 == 0 else 0.2)) + [f"t{i % 7}"] for i in range(120)}
    df = spark.createDataFrame([(k, v) for k, v in entries.items()], "id string, tokens array<string>")
    got = {r["id"]: (r["term"], r["posterior"]) for r in distinctive.elite_terms(df).collect()}
    terms = {t for v in entries.values() for t in v}
    best = {}
    for term in sorted(terms):
        counts = np.array([v.count(term) for v in entries.values()])
        values, freq = np.unique(counts, return_counts=True)
        fit = distinctive.fit_two_poisson(np.append(values, 0)[None].astype(float), np.append(freq, 0)[None].astype(float))
        d = int((counts > 0).sum())
        for key, c in zip(entries, counts):
            if c and d >= 2:
                p = float(distinctive.elite_posterior(np.array([c]), *fit)[0])
                best[key] = min(best.get(key, (1, 0, "")), (-round(p, 9), -c * np.log2(121 / d), term))
    assert {k: v[0] for k, v in got.items()} == {k: v[2] for k, v in best.items()}
    assert all(abs(got[k][1] + best[k][0]) < 1e-6 for k in got)


def test_histograms_are_fitted_in_bounded_blocks(monkeypatch):
    monkeypatch.setattr(distinctive, "CELLS", 50)
    lengths = np.array([3, 40, 1, 2, 60, 5])
    blocks = list(distinctive._blocks(lengths))
    assert sorted(np.concatenate(blocks).tolist()) == list(range(6)) and all(len(b) == 1 or len(b) * (lengths[b].max() + 1) <= 50 for b in blocks)


@pytest.mark.parametrize(("source", "doc", "want"), [
    ("// Adds the totals of all orders.\n\nfunc Sum(a int) int {\n\treturn a\n}", None, "Adds the totals of all orders."),
    ("// far away\n\n\n\nfunc Sum(a int) int { return a }", None, "far away"),
    ("@wraps\ndef f(a):\n    \"\"\"Reads rows from disk.\"\"\"\n    return a\nx = 1\n", None, "Reads rows from disk."),
    ("func Sum() {}", "Keeps the ledger open.", "Keeps the ledger open."), ("func Sum() {}", None, None), ("no code here", "Keeps it.", "Keeps it."),
])
def test_pair_of(source, doc, want):
    pair = functions.pair_of("Sum", None, doc, source)
    assert (pair[2] if pair else None) == want
    assert not pair or "x = 1" not in pair[1]


def test_ties_of_versions_agree(spark, rows):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    versions = [(i, "f", None, d, "func f() {}", at) for i in range(8) for d in ("Opens the store twice.", "todo")]
    df = spark.createDataFrame(versions, "id bigint, name string, signature string, doc_comment string, source string, indexed_at timestamp")
    assert rows(functions.documented_methods(df)) == rows(functions.method_pairs(df), "method_id")


@pytest.mark.parametrize("value", ["ana.k@kovanthe-family.org", "ANA@KOVANTHE.COM", "ana (at) mail dot kovanthe dot net"])
def test_domains_are_invented(value):
    first = personal.surrogate("email", value, b"k")
    assert "kovanthe" not in first.lower() and first[-3:] == value[-3:] and first == personal.surrogate("email", value, b"k")
    assert personal.surrogate("email", "x@kovanthe.com", b"k").split("@")[1] == personal.surrogate("email", "y@kovanthe.com", b"k").split("@")[1] != personal.surrogate("email", "y@other.com", b"k").split("@")[1]


def test_a_secret_is_drawn_without_a_key(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example")], "doc_id bigint, text string")
    names = spark.createDataFrame([], "token string, role string")
    first, second = (personal.redact_documents(docs, names).first()["text"] for _ in range(2))
    assert first != second and "a@b" not in first
    assert personal.redact_documents(docs, names, "k").first() == personal.redact_documents(docs, names, "k").first()


def test_few_labels_teach_a_forest(spark):
    hand = "def total_of_rows(rows):\n    # adds up what was sold\n    return sum(row.amount for row in rows)\n"
    data = "T = [" + ",".join(str(i * 37 % 1009) for i in range(900)) + "]\n"
    texts = [(i, hand.replace("rows", f"{w}_list")) for i, w in enumerate("order item part ship nation".split() * 4)] + [(50 + i, "# Code generated by x. DO NOT EDIT.\n" + data) for i in range(4)] + [(90, data)]
    files = spark.createDataFrame([(i, f"/repos/a/src/f{i}.py", T0) for i, _ in texts], "id bigint, absolute_path string, indexed_at timestamp")
    found = {r[0] for r in provenance.foreign_files(files, spark.createDataFrame(texts, "file_id bigint, content string")).collect()}
    assert found == {50, 51, 52, 53, 90}
