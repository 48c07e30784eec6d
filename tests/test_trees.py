import random
import subprocess

from quillspark.sources.trees import read_tree, tree_diff, tree_digests

SCHEMA = "path string, content binary"


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), SCHEMA)


def digests(spark, files):
    return {r.folder: (r.files, r.bytes, r.digest) for r in tree_digests(frame(spark, files)).collect()}


def test_a_digest_says_what_lies_below(spark):
    files = {"a/x.py": b"1", "a/y/z.py": b"22", "b/x.py": b"1", "b/y/z.py": b"22", "c.bin": b"\xff\x00"}
    found = digests(spark, files)
    assert set(found) == {"", "a", "a/y", "b", "b/y"} and found["a"] == found["b"] and found["a/y"] == found["b/y"] and found[""][:2] == (5, 8)
    assert digests(spark, dict(reversed(files.items()))) == found
    for path, content in (("a/x.py", b"2"), ("a/y/w.py", b""), ("c.bin", None)):
        other = digests(spark, files | {path: content})
        top = path.rpartition("/")[0]
        assert other[""] != found[""] and other[top] != found[top] and other["b"] == found["b"]
    assert digests(spark, {}) == {} and tree_digests(spark.createDataFrame([(None, b"1")], SCHEMA)).collect() == []


def test_patches_apply(spark, tmp_path):
    rng = random.Random(3)

    def text():
        lines = [rng.choice(["a", "b", "c\r", "ü", "", "  x", " y", "-- z", "++ w"]) for _ in range(rng.randint(0, 30))]
        return ("\n".join(lines) + rng.choice(["", "\n"])).encode()

    before = {f"d{i % 4}/f{i}.txt": text() for i in range(40)}
    after = {p: t for p, t in before.items() if rng.random() < 0.8}
    for p in list(after):
        if rng.random() < 0.7:
            lines = after[p].split(b"\n")
            for _ in range(3):
                lines.insert(rng.randrange(len(lines) + 1), rng.choice([b"new", b"", b"a"]))
                del lines[rng.randrange(len(lines))]
            after[p] = b"\n".join(lines)
    after |= {f"new/{i}.txt": text() + b"x" for i in range(5)}
    rows = sorted(tree_diff(frame(spark, before), frame(spark, after)).collect())
    assert {r.path: r.change for r in rows} == {p: "added" if p not in before else "deleted" if p not in after else "changed" for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    for p, t in before.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(t)
    patch = "".join(r.diff for r in rows if not (r.change != "changed" and not (before.get(r.path) or after.get(r.path))))
    subprocess.run(["git", "apply", "-p1", "--whitespace=nowarn", "-"], input=patch.encode(), cwd=tmp_path, check=True)
    left = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.txt")}
    assert {p: t for p, t in left.items() if t} == {p: t for p, t in after.items() if t}


def test_what_is_no_text_is_said(spark):
    rows = tree_diff(frame(spark, {"a": b"\xff", "b": b"x", "c": b"same", "d": None}), frame(spark, {"a": b"y", "b": b"\xfe", "c": b"same", "d": b""})).collect()
    assert {(r.path, r.change, r.diff) for r in rows} == {("a", "changed", None), ("b", "changed", None)}
    assert tree_diff(frame(spark, {}), frame(spark, {})).collect() == []


def test_a_tree_is_read_from_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"\xff\n")
    (tmp_path / "b.txt").write_text("b")
    assert {r.path: bytes(r.content) for r in read_tree(spark, str(tmp_path)).collect()} == {"x/a.bin": b"\xff\n", "b.txt": b"b"}
