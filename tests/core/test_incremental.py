"""An update equals the whole analysis, and parses and derives only what it must."""

import random

import pytest

from tracewright.operators.rules import default_rules
from tracewright.plans import incremental
from tracewright.session import fresh_path
from tracewright.sources.files import split_payload


def project(rnd, n=7):
    """Files that call, import and share keys at random."""
    out = {}
    for i in range(n):
        other, key = rnd.randrange(n), rnd.choice(["app.a", "app.b"])
        lines = [
            rnd.choice(["v = request.args.get('q')"] * 3 + ["v = 'fixed'", f"v = {key}"]),
            f"from m{other} import f{other}",
            f"{key} = v",
            f"w = f{rnd.randrange(n)}(v)",
            rnd.choice(["os.system(w)", "cursor.execute(w)", "print(w)", f"cursor.execute({rnd.choice(['app.a', 'app.b'])})"]),
            f"def f{i}(x):",
            rnd.choice(["    return x", "    y = int(x)\n    return y", "    cursor.execute(x)"]),
        ]
        out[f"m{i}.py"] = "\n".join([x for x in lines[:5] if rnd.random() < 0.8] + lines[5:])
    return out


def files_of(spark, projects):
    rows = [(scope, "".join(f"# === FILE: {name} ===\n{text}\n" for name, text in files.items())) for scope, files in projects.items()]
    return split_payload(spark.createDataFrame(rows, "scope string, payload string"))


def edited(rnd, files):
    files = dict(files)
    for name in rnd.sample(sorted(files), 2):
        what = rnd.choice(["drop", "change", "new"])
        if what == "drop":
            del files[name]
        elif what == "change":
            files[name] = rnd.choice(list(project(rnd).values()))
        else:
            files["a" + name] = rnd.choice(list(project(rnd).values()))
    return files


def rows_of(tables):
    return sorted(map(str, (tuple(r[c] for c in incremental.FINDING) for r in tables["findings"].collect())))


@pytest.mark.parametrize("seed", range(2))
def test_equals_whole(spark, seed):
    rnd = random.Random(seed)
    rules = default_rules(spark)
    projects = {f"p{i}": project(rnd) for i in range(3)}
    before = incremental.whole(files_of(spark, projects), rules)
    path = fresh_path(spark, "analysis")
    incremental.store(before, path)
    after = projects | {"p1": edited(rnd, projects["p1"]), "p9": project(rnd, 3)}
    got = incremental.update(files_of(spark, after), rules, incremental.load(spark, path))
    want = incremental.whole(files_of(spark, after), rules)
    assert rows_of(got) == rows_of(want) and any("taint" in r for r in rows_of(want))
    assert {r.scope for r in got["affected"].collect()} <= {"p1", "p9"}


def test_unlinked_files_stay(spark, monkeypatch):
    from tracewright.operators import parse

    alone = {f"x{i}.py": f"q{i} = request.args.get('q')\nos.system(q{i})\n" for i in range(4)}
    linked = {"lib.py": "def go(x):\n    os.system(x)\n", "use.py": "from lib import go\nq = request.args.get('q')\ngo(q)\n"}
    rules = default_rules(spark)
    before = incremental.whole(files_of(spark, {"p": alone | linked}), rules)
    parsed = []
    whole = parse.parse_files

    def counted(files):
        parsed.extend(r.path for r in files.select("path").collect())
        return whole(files)

    monkeypatch.setattr(parse, "parse_files", counted)
    after = alone | linked | {"lib.py": "def go(x):\n    print(x)\n"}
    got = incremental.update(files_of(spark, {"p": after}), rules, before)
    assert parsed == ["lib.py"]
    # the finding ended in an unchanged file's call into the changed one
    assert {r.file for r in got["affected"].collect()} == {"lib.py", "use.py"}
    assert {(r.source_file, r.sink_file) for r in got["findings"].where("analyzer = 'taint'").collect()} == {(f"x{i}.py", f"x{i}.py") for i in range(4)}


def test_nothing_changed(spark):
    files = {"p": project(random.Random(5))}
    rules = default_rules(spark)
    before = incremental.whole(files_of(spark, files), rules)
    got = incremental.update(files_of(spark, files), rules, before)
    assert got["affected"].count() == 0 and rows_of(got) == rows_of(before)
