"""File trees, ignore patterns, manifests and parsers."""

import pytest

from lodeline.operators import graph, iterate, resolve
from lodeline.sources import manifests, parse, tree
from lodeline.sources.ignore import Ignore


@pytest.mark.parametrize(
    "lines,path,folder,want",
    [(["*.log"], "a/b.log", False, True), (["/x"], "a/x", False, False), (["a/**/z"], "a/b/c/z", False, True), (["*.log", "!keep.log"], "keep.log", False, False), (["d/"], "d", False, False), (["d/"], "d/e.txt", False, True), (["d/", "!d/e.txt"], "d/e.txt", False, True), (["[ab].c"], "b.c", False, True), ([], ".env.local", False, True), ([], "../x", False, True), (["# no", ""], "no", False, False)],
)
def test_ignore(lines, path, folder, want):
    assert Ignore.of(lines, defaults=False).ignores(path, folder) is want


@pytest.fixture
def repo(tmp_path):
    files = {
        "pkg/__init__.py": "", "pkg/a.py": "from . import b\nfrom .b import Base\n\nclass Child(Base):\n    x: int = 1\n    def go(self, n: str) -> int:\n        'doc'\n        return helper(n)\n\ndef helper(n):\n    return unknown_thing(n)\n",
        "pkg/b.py": "__all__ = ['Base']\nclass Base: ...\n_hidden = 1\n", "bad.py": "def (", "web/x.ts": "import { y } from './y';\nexport class K extends L<T> implements M { run() { go(1); } }\nexport function f(a: string, b = 1): number { return g(a); }\nexport const c = 1;\n",
        "node_modules/skip.js": "x", ".hidden/deep/er/f.py": "x = 1", "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}', "requirements.txt": "flask==1\n-r more/dev.txt\n", "more/dev.txt": "pytest\n-r ../requirements.txt\n-r ../../out.txt\n", "unused.txt": "nope\n",
        "Pipfile": "[packages]\nrequests = \"*\"\n[scripts]\nx = 1\n[dev-packages]\n\"black\" = \"*\"\n", "pyproject.toml": "[project]\ndependencies = ['typer>=1']\n[tool.poetry.dependencies]\npython = '3'\nrich = '1'\n",
    }
    for k, v in files.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    (tmp_path / "pkg" / "bin.py").write_bytes(b"\0\1\2" * 50)
    return tmp_path


def _load(spark, repo, **options):
    tree.register(spark)
    return spark.read.format("repo_tree").option("path", str(repo)).options(**options).load()


def test_tree(spark, repo):
    paths = {r.path for r in _load(spark, repo, content="false").collect()}
    assert {"pkg/__init__.py", ".hidden/deep/er/f.py", "package.json"} <= paths and "node_modules/skip.js" not in paths
    assert {r.path for r in _load(spark, repo, depth="0").collect()} == {p for p in paths if "/" not in p}
    assert _load(spark, repo, maxBytes="1").where("error IS NOT NULL").count() > 5
    assert tree.project_root(str(repo / "pkg")) == str(repo)
    with pytest.raises(ValueError):
        tree.safe_path("../x", str(repo))


def test_manifests(spark, repo):
    files = _load(spark, repo).selectExpr("path", "decode(content, 'UTF-8') AS text").where("path NOT LIKE 'pkg%'")
    got = {tuple(r) for r in manifests.dependencies(files).collect()}
    assert got == {("npm", "react"), ("npm", "jest"), *(("python", x) for x in ("flask", "pytest", "requests", "black", "typer", "rich"))}


def test_parse_and_assemble(spark, repo):
    rows = {r.file_path: r for r in parse.parsed(_load(spark, repo)).collect()}
    assert rows["bad.py"].error and rows["pkg/bin.py"].error == "binary" and rows["pkg/b.py"].exports == ["Base"]
    child = rows["pkg/a.py"].entities[0]
    assert (child.name, child.kind, child.parent_classes, child.fields[0].name, child.methods[0].returns, child.called_entities) == ("Child", "CLASS", ["Base"], "x", "int", ["helper"])
    assert set(rows["pkg/a.py"].imports) == {"pkg", "pkg/b"}
    k, f = rows["web/x.ts"].entities
    assert (k.parent_classes, k.called_entities, f.inputs[0].name, f.outputs, rows["web/x.ts"].exports, rows["web/x.ts"].imports) == (["L", "M"], ["run", "go"], "a", "number", ["K", "f", "c"], ["./y"])
    g = resolve.assembled(parse.parsed(_load(spark, repo)))
    assert graph.dead_edges(g).count() == 0
    names = {r.id: r.name for r in g.nodes.collect()}
    links = {(names[r.src], names[r.dst], r.type, r.method) for r in g.edges.collect()}
    assert {("Child", "Base", "EXTENDS", "global_name"), ("Child", "helper", "CALLS", "file_local_match"), ("helper", "unknown_thing", "CALLS", "unresolved"), ("a.py", "b.py", "IMPORTS", "path")} <= links
    assert {r.path for r in iterate.impact(g, "pkg/b.py").collect()} >= {"pkg/a.py"}


def test_helpers():
    assert not parse.is_binary("hällo".encode()) and parse.is_binary(b"\0\1") and parse.decoded("x".encode("utf-16")) == "x"
    assert "..." in parse.without_bodies("def f():\n    'd'\n    return 1") and parse.without_bodies("def (") == "def ("
    assert parse.tsconfig_aliases('{"compilerOptions": {"paths": {"@/*": ["./src/*"], /* c */ "x": ["y"],}}}') == [("@/", "src/", 0), ("x", "y", 1)]
    assert parse.tsconfig_aliases("{") == []
