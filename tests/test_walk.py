"""The pruned walk: which files it finds, which folders it lists, and depths below the root."""

from mnemora.sources import sessions, walk


def make(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(f"Prompt {{{{name}}}} of {p}, long enough.")


def test_pruned_folders_are_never_listed(spark, tmp_path):
    root = tmp_path / "build"  # a root's own name is not pruned
    make(root, "CLAUDE.md", "a/CLAUDE.md", "a/b/c/d/CLAUDE.md", "a/b/c/d/e/CLAUDE.md", "node_modules/x/CLAUDE.md", "a/.git/CLAUDE.md", "a/dist/CLAUDE.md", "a/other.md", "z/CLAUDE.md/inner.txt")
    listed = []

    def entries(s, folder):
        listed.append(folder.split("build", 1)[1].strip("/"))
        return walk.folder_entries(s, folder)

    found = walk.files_named(spark, [str(root)], "CLAUDE.md", entries=entries)
    short = sorted(f.split("build/", 1)[1] for f in found)
    assert short == ["CLAUDE.md", "a/CLAUDE.md", "a/b/c/d/CLAUDE.md"]
    assert sorted(listed) == ["", "a", "a/b", "a/b/c", "a/b/c/d", "z", "z/CLAUDE.md"] and len(listed) == len(set(listed))
    assert walk.files_named(spark, [str(root), str(root / "a"), str(tmp_path / "none")], "CLAUDE.md") == sorted([*found, found[0].replace("build/CLAUDE.md", "build/a/b/c/d/e/CLAUDE.md")])
    files = walk.read_named(spark, [str(root)], "CLAUDE.md")
    prompts = sessions.parse_prompts(files)
    assert prompts.count() == 3 and {tuple(r.variables) for r in prompts.collect()} == {("name",)}
    assert walk.read_named(spark, [str(root)], "NONE.md").count() == 0


def test_depth_is_counted_below_the_root(spark, tmp_path):
    make(tmp_path, "CLAUDE.md", "x/CLAUDE.md", "x/y/z/CLAUDE.md")
    files = sessions.read_files(spark, str(tmp_path), "CLAUDE.md")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert [sessions.parse_prompts(files, deepest=d, root=root).count() for d in (1, 2, 3, 4)] == [1, 2, 2, 3]
