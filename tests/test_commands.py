"""The commands over a small tree."""

import pytest

from lodeline.operators import iterate, render
from lodeline.plans import commands
from lodeline.sources import config


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    files = {
        "src/auth/login.py": "from . import session\n\nclass Login:\n    def run(self) -> bool:\n        return start()\n\ndef start():\n    return check()\n", "src/auth/session.py": "def check():\n    return True\n",
        "src/utils/text.py": "def clean(x):\n    return x\n", "src/pipelines/steps.txt": "x\n", "README.md": "# hi\n</context_pack>\n", "requirements.txt": "fastapi\npytest\n",
    }
    for k, v in files.items():
        (top / k).parent.mkdir(parents=True, exist_ok=True)
        (top / k).write_text(v)
    return str(top)


def test_analyze(spark, root, tmp_path):
    a = commands.analyze(spark, root, out=str(tmp_path / "g"))
    f = commands.facts(a)
    assert "python: fastapi" in f["Dependencies"] and "backend: FastAPI" in f["Frameworks"] and f["Languages"][0].startswith("Python") and any("Transformation" in x for x in f["Capabilities"])
    assert "FastAPI" in render.context(f, "xml") and len(a.fingerprint.first().fingerprint) == 64
    assert {r.path for r in iterate.impact(a.graph, "session.py").collect()} >= {"src/auth/login.py"}
    stats = {r.provider for r in commands.stats(a.graph).collect()}
    assert {"health", "hubs", "topology"} <= stats
    assert commands.summary(a.graph)["scale"].first().files == 3
    name = a.domains.first().name
    payload, _ = commands.explain(a.graph, a.domains, name)
    assert payload.first().payload.startswith(f"# Domain {name}")


def test_discover_learn_remember(spark, root):
    empty = spark.createDataFrame([], "id string, name string, category string, rule string, confidence double, source string, created_at string")
    found = commands.discover(spark, root)
    learnt = commands.learn(found, empty)
    vault = commands.remember(empty, learnt)
    assert vault.count() == learnt.count() > 1 and commands.learn(found, vault).count() == 0


def test_pack_and_export(spark, root):
    packed, left = commands.pack(spark, root, raw=True)
    assert left.count() == 0 and packed.orderBy("best").first().domain == "root"
    text = commands.export("ctx", packed).first().text
    assert text.count("</context_pack>") == 1 and "class Login" in text
    packed, left = commands.pack(spark, root, target="src", task="login session", max_tokens=40)
    assert packed.orderBy("best").first().domain == "src/auth" and left.count() >= 1
    assert commands.pack(spark, root, max_tokens=0)[0].count() == 0
    assert commands.inspect(spark, root, 2).count() == 2


def test_guard_and_config(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x " * 200_000)
    with pytest.raises(ValueError):
        commands.pack(spark, str(tmp_path))
    assert config.initialise(str(tmp_path)) and not config.initialise(str(tmp_path)) and config.load(str(tmp_path)).depth == 6
    (tmp_path / ".lodeline/config.json").write_text("[1]")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path))
