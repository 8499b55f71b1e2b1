"""Level tables as objects and as bare arrays."""

import json

from tracklens.sources import files

ENTRIES = [{"md5": "AB", "sha256": None, "level": "12+"}, {"sha256": "CD", "level": 7}, {"md5": "EF", "level": "?"}, {"level": "3"}, "no object", {"md5": "12"}]


def read(spark, path, **how):
    return sorted(((r.name, r.sha256, r.md5, r.level) for r in files.read_level_table(spark, str(path), **how).collect()), key=repr)


def test_both_forms_give_the_same_rows(spark, tmp_path):
    (tmp_path / "object.json").write_text(json.dumps({"name": "tab", "data": ENTRIES}, indent=1))
    (tmp_path / "array.json").write_text(json.dumps(ENTRIES, indent=1))
    want = [("tab", "cd", None, 7.0), ("tab", None, "ab", 12.0)]
    assert read(spark, tmp_path / "object.json", whole_files=True) == want
    assert read(spark, tmp_path / "array.json", whole_files=True, name="tab") == want
    assert [r[0] for r in read(spark, tmp_path / "array.json", whole_files=True)] == ["array", "array"]


def test_lines_and_folders(spark, tmp_path):
    (tmp_path / "name=x").mkdir()
    (tmp_path / "name=x" / "part.txt").write_text(json.dumps(ENTRIES) + "\nnot json\n" + json.dumps({"name": "own", "data": ENTRIES[:1]}) + "\n")
    assert [r[0] for r in read(spark, tmp_path)] == ["own", "x", "x"]
