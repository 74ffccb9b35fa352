import pytest

from querysmith import __main__ as cli


def test_run_and_optimal(spark, tmp_path):
    d = tmp_path / "toy"
    d.mkdir()
    (d / "source.csv").write_text("id,name\n1,alpha beta\n2,gamma delta\n1,alpha runners\n")
    (d / "target.csv").write_text("id,text\n1,runner and alpha\n2,gamma rays\n3,alpha\n")
    (d / "ground_truth.csv").write_text("a,b\n1,1\n2,2\n")
    args = f"--data {tmp_path} --out {tmp_path}/out --dataset toy --iterations 6 --keys 1 --model idf --batch 6".split()
    out = cli.run(spark, args)
    log = spark.read.parquet(out)
    assert log.count() == 6 and {r.local_id for r in log.collect()} <= {"l:1", "l:2"} and log.filter("rr >= 0.5").count() == 6
    assert cli.run(spark, args) == out and spark.read.parquet(out).count() == 6  # it is there already
    best = spark.read.parquet(cli.find_optimal(spark, f"--data {d} --out {tmp_path}/best --most 2 --last 2".split()))
    got = {(r.local_id, tuple(r.query), r.rr) for r in best.collect()}
    assert got == {("l:1", ("runner",), 1.0), ("l:1", ("alpha", "runner"), 1.0), ("l:2", ("gamma",), 1.0), ("l:2", ("delta", "gamma"), 1.0)}
    assert cli.main([]) == 2


def test_command_of_the_batch_file():
    """Lists of runs and seeds, options without a value, options that are accepted where they change nothing."""
    from querysmith import config

    args = "--dataset=cord_1 --iterations=2000 --keys=32 --average_runs=1,2,5 --model=dataset_level --distribution=uniform --alpha=.2 --term_borrowing=false --ts_features=false --seeds=7,8,9 --p_thresh="
    run = config.parse(args.split(" "))
    assert run.run_ids == (1, 2, 5) and [run.seed(i) for i in run.run_ids] == [7, 8, 9] and run.policy.p_thresh is None
    assert config.parse(f"{args}0.5 --lm_prefixes=0 --evaluation_interval=0 --evaluation_sample=0".split()).policy.p_thresh == 0.5
    named = config.parse(f"{args} --evaluation_interval=100".split())
    assert config.save_path("/r", named) != config.save_path("/r", run) and "ev_in=100" in config.save_path("/r", named)
    for wrong in ("--lm_prefixes=5", "--average_runs=0", "--average_runs=2,2"):
        with pytest.raises(SystemExit):
            config.parse([*args.split(" "), wrong])


def test_files_of_a_directory_count_by_name(spark, tmp_path):
    d = tmp_path / "toy"
    (d / "source.csv").mkdir(parents=True)
    (d / "source.csv" / "a.csv").write_text("id,name\n1,first\n")
    (d / "source.csv" / "b.csv").write_text("id,name\n" + "".join(f"{i},filler number {i}\n" for i in range(2, 200)) + "1,last\n")
    (d / "target.csv").write_text("id,text\n1,last one\n")
    (d / "ground_truth.csv").write_text("a,b\n1,1\n")
    assert cli.load(spark, str(d)).local.filter("id = 'l:1'").first().name == "last"
