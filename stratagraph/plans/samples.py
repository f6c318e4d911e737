"""Small inputs whose results are known: sources of every language, patches, addresses, parameters and a repository."""

from __future__ import annotations

import os
import subprocess
import uuid

#: Language: source, symbols, functions that a change of every line touches, comments.
SOURCES = {
    "python": ('import os as system\nfrom pkg.mod import tool\n\nclass Box:\n    def open(self):\n        # inside\n        return tool(system)\n\ndef main():\n    """Says it."""\n    return Box\n', ["Box", "Box.open", "main"], ["Box.open", "main"], ["# inside", "Says it."]),
    "javascript": ("import base, { part as piece } from './lib';\n// top\nfunction run(a) {\n  return piece(a);\n}\nconst size = 3;\n", ["run", "size"], ["run"], ["// top"]),
    "typescript": ("class Store {\n  load(key: string): number {\n    return 1; /* one */\n  }\n}\nlet open = 2;\n", ["load", "open"], ["load"], ["/* one */"]),
    "c": ("/* head */\nstatic int add(int a, int b) {\n  return a + b;\n}\n", ["add"], ["add"], ["/* head */"]),
    "cpp": ("// c\nvoid Node::walk(int depth) {\n  if (depth) { }\n}\n", ["Node::walk"], ["Node::walk"], ["// c"]),
    "go": ('package main\n// entry\nfunc Main(x int) int {\n\ts := "}"\n\treturn x\n}\nfunc (t *T) Do() {\n}\n', ["Main"], ["Main"], ["// entry"]),
    "java": ("/* head */\npublic class A {\n  private int run(int x) {\n    return x; // done\n  }\n}\n", [], [], ["/* head */", "// done"]),
    "rust": ("// r\nimpl Foo {\n    pub fn go(&self) -> char {\n        '}'\n    }\n}\n", [], [], ["// r"]),
    "php": ("<?php\n# note\nfunction top($x) {\n  return $x;\n}\n", ["top"], ["top"], ["# note"]),
    "swift": ("class V {\n  func draw(a: Int) -> Int {\n    return a // s\n  }\n}\n", ["draw"], ["draw"], ["// s"]),
    "kotlin": ("fun one(x: Int) = x // q\n", ["one"], ["one"], ["// q"]),
    "scala": ("class P(x: Int) {\n  def size(y: Int): Int = {\n    y // t\n  }\n}\n", ["P", "P.size"], ["P.size"], ["// t"]),
    "ruby": ("# r\ndef go(x)\n  x\nend\n", [], [], ["# r"]), "c_sharp": ("class A {\n  int Run(int x) {\n    return x; // c\n  }\n}\n", [], [], ["// c"]),
    "lua": ("-- l\nlocal function add(a, b)\n  return a + b\nend\n", ["add"], ["add"], ["-- l"]), "bash": ('# b\nbuild() {\n  echo "}"\n}\n', ["build"], ["build"], ["# b"]),
    "perl": ("# p\nsub go {\n  return 1;\n}\n", ["go"], ["go"], ["# p"]), "r": ("# r\nf <- function(x) {\n  x\n}\n", [], [], ["# r"]), "sql": ("-- q\nSELECT 1;\n", [], [], ["-- q"]),
    "html": ("<!-- h -->\n<p>x</p>\n", [], [], ["<!-- h -->"]), "yaml": ("# y\na: 1\n", [], [], ["# y"]), "css": ("/* x */\n.a { color: red; }\n", [], [], ["/* x */"]), "json": ('{"a": 1}', [], [], []),
}
#: Language, alias and what it stands for, in the sources above.
IMPORTS = [("python", "system", "os"), ("python", "tool", "pkg.mod.tool"), ("javascript", "base", "./lib.default"), ("javascript", "piece", "./lib.part")]
#: Kinds of nodes of the python source's tree: type, depth, how many.
TREE = [("module", 0, 1), ("class_definition", 1, 1), ("function_definition", 1, 1), ("function_definition", 2, 1), ("return_statement", 3, 1), ("return_statement", 2, 1)]
#: Patch, lines touched, text added.
PATCHES = [
    ("@@ -1,2 +1,3 @@\n-old\n+new\n+more\n same\n", [1, 2], "new\nmore"), ("@@ -5 +7 @@\n+++x\n", [7], "++x"), ("@@ -3,2 +2,0 @@\n-a\n-b\n", [], ""), (None, [], ""), ("", [], ""),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1,2 @@\n+one\n+two\n\\ No newline at end of file\n@@ -9,0 +12,1 @@ def f\n+three\n", [1, 2, 12], "one\ntwo\nthree"),
]
#: Address of a remote, owner, repository.
REMOTES = [("https://github.com/acme/demo.git", "acme", "demo"), ("git@github.com:acme/demo.git", "acme", "demo"), ("https://github.com/acme/demo/", "acme", "demo"), ("https://x-access-token:*@github.com/a-b/c.d", "a-b", "c.d"), ("https://example.org/acme/demo", None, None), ("", None, None)]
#: Filters and parameters as typed, and how they are read.
FILTERS = [(["file:core", "Author: er "], [("FILE", "core"), ("AUTHOR", "er")]), (["a:1", "A:2:3", "none"], [("A", "2:3")])]
PARAMETERS = [(["Tasks:regex=#(a=b)", "Tasks:team=x", "odd"], [("Tasks", "regex", "#(a=b)"), ("Tasks", "team", "x")])]
#: The commits of a repository: message, files, and what a history of it says.
COMMITS = [("Initial parser", {"main.py": "import os\n\ndef main():\n    return os.getenv('DB_PASS')\n"}), ("Change parser #12\n\nBody |~| line", {"main.py": "import os\n\ndef main():\n    x = 1\n    return os.getenv('DB_PASS')\n", "core/lex.go": "package core\nfunc Lex() int {\n\treturn 1\n}\n"}), ("Drop the lexer", {"core/lex.go": None})]


def repository(folder: str) -> str:
    """A git repository of COMMITS in a new folder below ``folder``, with stated names and dates, so that ids are always the same."""
    path = os.path.join(folder.removeprefix("file://").removeprefix("file:"), f"sample-{uuid.uuid4().hex}", "demo")
    os.makedirs(path)
    run = lambda *args, **kw: subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, **kw)
    run("init", "-q", "-b", "main")
    for i, (message, files) in enumerate(COMMITS):
        for name, text in files.items():
            at = os.path.join(path, name)
            if text is None:
                os.remove(at)
                continue
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(text)
        run("add", "-A")
        stamp = f"2024-01-0{i + 1}T00:00:00+00:00"
        run("-c", "user.name=Ann B", "-c", "user.email=ann@x.test", "commit", "-q", "-m", message, env={**os.environ, "GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp})
    return path
