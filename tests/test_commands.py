from gristdex.commands import dump_lines, main, run_load


def write(path, *lines):
    path.write_text("".join(x + "\n" for x in lines))
    return str(path)


def test_load_merge_and_dump(spark, tmp_path, capsys):
    t = lambda n: str(tmp_path / n)
    dump = lambda *a: list(dump_lines(spark, list(a)))
    run_load(spark, ["--output-type=summaries", "--base=100", t("pages"), write(tmp_path / "p.tsv", 'b\t{"x":1}', "a\t{}")])
    cat = write(tmp_path / "catalog.tsv", f"summary\t{t('pages')}\t100")
    assert dump("--format=summaries", t("pages")) == ["a\t{}", 'b\t{"x":1}']
    run_load(spark, ["--output-type=index", "--schema", cat, "--add-key-prefix=foo:", t("index"), write(tmp_path / "i.tsv", "red\ta\t1", "red\tb\t2", "blue\tb\t0.5", "blue\tgone\t7")])
    assert dump("--format=index", "--raw", t("index")) == ["foo:blue", "\t101 0.5", "foo:red", "\t100 1", "\t101 2"]
    assert dump("--format=index", "--schema", cat, "--key-filter=foo:r.*", t("index")) == ["a\t{}\t1", 'b\t{"x":1}\t2']
    assert dump("--format=index", "--keys-only", "--prefix=foo:c", t("index")) == ["foo:red"] and dump("--format=index", "--count", t("index")) == ["3"]

    one = write(tmp_path / "1.tsv", "k\t2024-01-01 00:00:00\t0.5", "b\t2024-01-02 00:00:00\t6 1 2 3 4")
    two = write(tmp_path / "2.tsv", "k\t2024-01-03 00:00:00\t4", "b\t2024-01-02 00:00:00\t7")
    run_load(spark, [t("s1"), one])
    run_load(spark, ["--threshold=1", t("s2"), two])
    merged = ["--input-format=table", "--merge-mode=pick-one", "--output-compression=none"]
    run_load(spark, [*merged, t("s"), t("s1"), t("s2")])
    assert dump("--date-format=%d.%m.%Y", t("s")) == ["b\t02.01.2024\t7", "k\t01.01.2024\t0.5", "k\t03.01.2024\t4"]
    assert dump("--ts-format=count", t("s")) == dump("--count", t("s")) == ["b\t1", "k\t2"]
    run_load(spark, ["--input-format=table", "--shard-count=2", "--shard-index=0", t("h0"), t("s")])
    run_load(spark, ["--input-format=table", "--shard-count=2", "--shard-index=1", t("h1"), t("s")])
    assert sorted(dump(t("h0")) + dump(t("h1"))) == dump(t("s"))
    run_load(spark, ["--input-format=table", "--key-filter=b", "--strip-key-prefix=b", t("e"), t("s")])
    assert dump("--keys-only", t("e")) == [""]

    assert main(["load", "--input-format=table", t("bad"), t("s1"), t("s2")]) == 1  # different scores
    assert main(["load", "--output-type=index", t("bad"), one]) == 1 and main([]) == 64
    assert "error" in capsys.readouterr().out
