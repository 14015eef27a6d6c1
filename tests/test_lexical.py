"""The lexical pass against the syntax tree."""

from __future__ import annotations

import ast
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from custodia.functions import lexical
from custodia.operators import corpus
from tests.conftest import rows, scripts

SCRIPTS = [
    '"""\nimport requests\n\n@flow\ndef fake(a):\n    pass\n"""\nimport os\ndef real(b):\n    pass\n',
    "x = 'import a; import b'\ny = \"from c import d\"  # import e\nimport f\n",
    "# don't\nimport a\n# it's\nimport b\n",
    "import a, \\\n  b.c as d, \\\n  e\nfrom \\\n .f import g\nfrom . import h\nfrom ..i.j import *\n",
    "r'''\\'''\nimport hidden\n'''\nimport seen\n",
    "x = foo(a\n@b)\ndef f(): pass\n",
    "@task\n# note ( [\n\n@a.b.flow  # twice )\n@called(1)\n@ spaced\ndef f(a, /, b, c=(1, ')'), *d, e=2, **g): return '''\ndef no(): pass\n'''\n",
    "def f(a=lambda x, y: {x: y}, b=[1, (2, 3)], c: Dict[str, int] = {}, *, k=1) -> 'x, y':\n    def inner(q): pass\n    import z\n",
    "def f(\n    a,  # a ) comment\n    b=\"),\",\n    # c,\n    d=1,\n):\n    pass\n\n\n@flow\n\ndef g(): pass\n",
    "async def h(a): pass\n@flow\nclass K:\n    @task\n    def m(self): pass\ndef after(): pass\n",
    "if x: import a\ntry: import b; import c\nexcept ImportError: from d import e\n",
    "x = 'a\\\nimport no\\\n'\nimport yes\n",
    "import é.f\r\nimport g\rdef h(ä): pass\n",
    "s = '''it's \"quoted\" \\''' import no'''; import yes\n",
    "x = {\n  'a': [\n    1,\n  ],\n}\nimport a\nif (1 +\n    2): import b\n",
    "def f(a\n      , b): pass\ndef g(*, a): pass\ndef h(*args, b): pass\ndef i(a, *, b): pass\n",
    "x = f'{y!r} {\"a\"}' + b'import n' + rb'\\' import m'\nimport z\n",
    "",
    "\n\n",
]


def tree_facts(source: str):
    tree, imports, functions = ast.parse(source), set(), []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.add(node.module.split(".")[0])
    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            found = [d.id if isinstance(d, ast.Name) else d.attr for d in node.decorator_list if isinstance(d, (ast.Name, ast.Attribute))]
            functions.append((node.name, found, node.lineno, [a.arg for a in node.args.args]))
    return sorted(imports), functions


def lexed_facts(spark, *sources: str):
    cut = lexical.lexed(scripts(spark, *sources).repartition(4))
    found = cut.select("script_id", lexical.imports(F.col("_logical")).alias("imports"), lexical.functions(F.col("_logical")).alias("functions"))
    return [(r["imports"], [(f["name"], f["decorators"], f["line_no"], f["args"]) for f in r["functions"]]) for r in found.orderBy("script_id").collect()]


def test_as_the_syntax_tree(spark):
    for source, got in zip(SCRIPTS, lexed_facts(spark, *SCRIPTS), strict=True):
        assert got == tree_facts(source), source


def test_real_modules_as_the_syntax_tree(spark):
    here = Path(__file__).parent.parent
    paths = [*here.glob("custodia/**/*.py"), *sorted(Path(os.__file__).parent.glob("[a-h]*.py"))]
    sources = [p.read_text(encoding="utf-8") for p in paths]
    for path, source, got in zip(paths, sources, lexed_facts(spark, *sources), strict=True):
        assert got == tree_facts(source), path


def test_columns_are_whole_strings_outside_comments(spark):
    code = "df.select('email', \"_no\", 'two words', 'x')  # 'phone' isn't \"name\"\n'''long'''\nf('é1')\n"
    found = lexical.lexed(scripts(spark, code)).select(lexical.columns(F.col("_tokens")).alias("c")).first()["c"]
    assert found == ["email", "é1"]


def test_rows_of_facts(spark):
    found = corpus.lexical_facts(scripts(spark, SCRIPTS[0], "", None), "code", "script_id")
    assert rows(found, "kind") == [
        (0, "function", "real", 9, "", "b"),
        (0, "import", "os", None, None, None),
    ]


@pytest.mark.parametrize(
    "long",
    ['x = "' + "\\n" * 100_000 + '"\n', '"""' + "a\n" * 100_000 + '"""\n', "f(\n" + "1,\n" * 50_000 + ")\n", "# x\n" * 50_000, "(" * 5000 + ")" * 5000 + "\n"],
    ids=["escapes", "docstring", "argument list", "comments", "depth"],
)
def test_long_scripts(spark, long):
    start = time.monotonic()
    assert lexed_facts(spark, long + "import a\ndef f(x): pass\n") == [(["a"], [("f", [], long.count("\n") + 2, ["x"])])]
    assert time.monotonic() - start < 30
