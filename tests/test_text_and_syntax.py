import difflib
import random

from pyspark.sql import functions as F

from stratagraph.functions import patch as P
from stratagraph.functions import syntax as Y
from stratagraph.functions import text as X
from stratagraph.operators.versions import match_versions, ordered_versions, quick_ratio, quick_ratio_column, version_graph


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).head()[0]


def test_keywords(spark):
    stops = X.stop_words(spark)
    assert one(spark, X.keywords(F.col("t"), stops), t="Fix the parsers at https://x.y/z and 2 boxes, it's caches") == ["parser", "box", "cache"]
    assert one(spark, X.keywords(F.col("t"), stops, is_code=True), t="getUserNames_by-id") == ["get", "user", "name"]
    assert one(spark, X.keywords(F.col("t"), stops), t=None) == []


def test_small_expressions(spark):
    assert one(spark, X.language_of(F.col("t")), t=".PY") == "python" and one(spark, X.language_of(F.col("t")), t=".zz") is None
    assert one(spark, X.time_bucket(F.col("t")), t="2024-03-09T10:00:00+02:00") == "2024-03" and one(spark, X.time_bucket(F.col("t")), t="soon") == "2000-01" and one(spark, X.time_bucket(F.col("t")), t=None) == "2000-01"
    assert one(spark, X.extension(F.col("t")), t="a.b/c.tar.gz") == ".gz" and one(spark, X.extension(F.col("t")), t="a/.env") == "" and one(spark, X.base_name(F.col("t")), t="a/b.c") == "b.c"
    for url in ("https://github.com/o/r.git", "git@github.com:o/r.git", "https://github.com/o/r/"):
        assert tuple(one(spark, X.remote(F.col("t")), t=url)) == ("o", "r")
    assert one(spark, X.remote(F.col("t")), t="https://else.where/o/r") is None
    assert one(spark, X.numbers(F.col("t")), t="#12 and (#7), #12") == ["12", "7"]
    assert one(spark, X.references(F.col("t"), r"CU-(\w+)|task/(\w+)"), t="CU-ab1 task/zz") == ["ab1", "zz"]
    code = "os.getenv('STRIPE_API_KEY') process.env.B os.environ['C'] os.environ.get(\"D\") getenv(\"E\")"
    assert one(spark, X.secrets(F.col("t")), t=code) == ["STRIPE_API_KEY", "B", "C", "D", "E"]
    assert X.parse_filters(["file:a:b", "File:c", "none"]) == {"FILE": "c"}
    assert X.parse_parameters(["P:k=v=w", "P:l=", "bad"]) == {"P": {"k": "v=w", "l": ""}}


def test_patches():
    text = "@@ -1,2 +3,2 @@\n-old\n-++gone\n+new\n+++more\n\\ No newline at end of file\n@@ -9 +10,0 @@\n-x\n@@ -20,0 +30 @@\n+last\n"
    assert P.parse_patch(text) == ([3, 4, 30], "new\n++more\nlast")
    assert P.parse_patch(None) == ([], "")
    assert P.touches([3, 9], 4, 9) and not P.touches([3, 9], 4, 8) and not P.touches([], 1, 5)


def test_python_syntax():
    source = "import os.path\nimport numpy as np\nfrom a.b import c as d, e\n\n@deco\nclass K:\n    '''Doc.'''\n    def m(self):\n        def inner():\n            pass\n        return np.x(d)  # note\n\nasync def run():\n    return K()\n"
    p = Y.parse(source, "python")
    assert [d.name for d in p.definitions] == ["K", "K.m", "K.m.inner", "run"]
    assert p.imports == {"os": "os.path", "np": "numpy", "d": "a.b.c", "e": "a.b.e"}
    got = Y.analyse(source, "python", "@@ -1,0 +11 @@\n+x\n")
    assert set(got["touched"]) == {"K", "K.m", "numpy", "a.b.c"} and [f["name"] for f in got["functions"]] == ["K.m"] and got["comments"] == [{"text": "# note", "kind": "inline", "line": 11}]
    assert [d.name for d in Y.parse("def f(:\n  x\nclass A:\n  def g(self):\n    y\n", "python").definitions] == ["f", "A", "A.g"]
    assert [n["type"] for n in Y.tree("def f():\n    return 1\n", "python")][:3] == ["module", "function_definition", "return_statement"] or "return_statement" in [n["type"] for n in Y.tree("def f():\n    return 1\n", "python")]
    assert all(n["depth"] <= 1 for n in Y.tree(source, "python", 1)) and Y.tree("", "python") == [] and Y.tree("x = (", "python") == []


def test_brace_languages():
    tsx = "import React, { useState as us, type T } from 'react';\nimport * as all from \"m\";\n// const no = 1\nexport const App = (p: string) => {\n  const s = 'function fake() {';\n  function inside() { return us(1); }\n  return s;\n};\nclass C {\n  go(a: number): void {\n    if (a) { all.x(); }\n  }\n}\nfunction plain() { return `}`; }\n"
    p = Y.parse(tsx, "tsx")
    names = [(d.name, d.kind, d.start, d.end) for d in p.definitions]
    assert ("App", "lexical_declaration", 4, 8) in names and ("App.inside", "function_declaration", 6, 6) in names and ("plain", "function_declaration", 14, 14) in names and ("go", "method_definition", 10, 12) in names
    assert "fake" not in [n[0] for n in names] and p.imports == {"React": "react.default", "us": "react.useState", "T": "react.T", "all": "m.*"}
    assert "react.useState" in Y.analyse(tsx, "tsx", "@@ -6 +6 @@\n+x\n")["touched"]
    c = "#include <x.h>\n/* a {\n b */\nstatic int *add(int a,\n    int b) {\n  return a + b; // sum\n}\nint main(void) { while (1) { add(1, 2); } }\n"
    assert [(d.name, d.start, d.end) for d in Y.parse(c, "c").definitions] == [("add", 4, 7), ("main", 8, 8)]
    assert [k for _, k, *_ in Y.parse(c, "c").comments] == ["block", "inline"]
    assert Y.parse("x", None).definitions == Y.parse(None, "c").definitions == Y.parse("fn f() {}", "cobol").definitions == [] and Y.analyse("fn f() {}", "rust", None)["definitions"] == []


def test_quick_ratio(spark):
    rng = random.Random(0)
    pairs = [("".join(rng.choice("ab c\n.x") for _ in range(rng.randrange(30))), "".join(rng.choice("ab c\n.y") for _ in range(rng.randrange(30)))) for _ in range(60)] + [("", ""), ("", "a")]
    got = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(quick_ratio_column(F.col("a"), F.col("b"))).collect()]
    for (a, b), column in zip(pairs, got):
        assert abs(quick_ratio(a, b) - difflib.SequenceMatcher(None, a, b).quick_ratio()) < 1e-12 and abs(column - quick_ratio(a, b)) < 1e-12


def test_histories(spark):
    rows = [("f", 1, "c1", "a.py", "return one"), ("f", 2, "c2", "a.py", "zzzzzz"), ("f", 3, "c3", "b.py", "qqqqqqqqqqqqqq"), ("f", 4, "c4", "c.py", "zzzzzy"), ("g", 1, "c1", "a.py", "x"), (None, 1, "c", "p", "x"), ("h", 1, None, None, None)]
    v = match_versions(spark.createDataFrame(rows, "function string, seq bigint, commit_id string, file_path string, content string"))
    got = {(r.function, r.seq): r for r in v.collect()}
    assert len(got) == 6 and got["f", 1].history_id == got["f", 2].history_id == got["f", 4].history_id != got["f", 3].history_id
    assert got["f", 2].previous_id == got["f", 1].version_id and got["f", 4].previous_id == got["f", 2].version_id and got["f", 3].previous_id is None
    _, edges = version_graph(v)
    places = {r.version_id: r.place for r in ordered_versions(edges).collect()}
    assert [places[got["f", s].version_id] for s in (1, 2, 4, 3)] == [1, 2, 3, 1]
    assert match_versions(v.limit(0).select("function", "seq", "commit_id", "file_path", "content")).count() == 0


def test_histories_go_on_from_what_is_stored(spark):
    schema = "function string, seq bigint, commit_id string, file_path string, content string"
    rows = [("f", i, f"c{i}", "a.py", f"return {i}") for i in range(4)]
    whole = {r.version_id: r.previous_id for r in match_versions(spark.createDataFrame(rows, schema)).collect()}
    first = match_versions(spark.createDataFrame(rows[:2], schema)).collect()
    known = spark.createDataFrame([(r.function, r.history_id, r.version_id, r.file_path, r.content) for r in first[1:]], "function string, history_id string, version_id string, file_path string, content string")
    later = match_versions(spark.createDataFrame(rows[2:], schema), known).collect()
    assert {r.version_id: r.previous_id for r in [*first, *later]} == whole
