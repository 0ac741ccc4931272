"""A worker dies mid-job; the task is retried and the job still produces every result."""

import os
import subprocess
import sys
import tempfile
import textwrap

SCRIPT = textwrap.dedent("""
    import os, sys, tempfile
    sys.path.insert(0, {repo!r})
    from pyspark import cloudpickle
    from linguaspark.session import get_spark
    from linguaspark.plans import jobs as J

    MARK = {mark!r}

    class CrashOnce:
        def __call__(self, texts):
            if not os.path.exists(MARK):
                open(MARK, "w").close()
                os._exit(1)            # the Python worker dies: the task fails and is retried
            return ["[ja] " + t.split("\\n\\n")[1] for t in texts]   # the text inside the prompt

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = get_spark("local[4,3]", shuffle_partitions=4, conf={{
        "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": tempfile.mkdtemp()}})
    E = "catalog string, lang string, key string, value string, ord bigint"
    src = spark.createDataFrame([("app", "en", f"k{{i}}", f"v{{i}}", i) for i in range(40)], E)
    tgt = spark.createDataFrame([], E)
    res = J.translate(src, tgt, ["ja"], CrashOnce(), max_parallel=4)
    got = sorted((r.key, r.value) for r in res.entries.collect())
    assert got == sorted((f"k{{i}}", f"[ja] v{{i}}") for i in range(40)), got
    assert res.results.where("error is not null").count() == 0
    print("RESILIENT", os.path.exists(MARK))
""")


def test_job_survives_a_lost_worker():
    mark = os.path.join(tempfile.mkdtemp(), "crashed")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "resilience.py")
    with open(path, "w") as f:
        f.write(SCRIPT.format(repo=repo, mark=mark))
    out = subprocess.run([sys.executable, path], capture_output=True, text=True, timeout=600)
    assert "RESILIENT True" in out.stdout, out.stdout[-2000:] + out.stderr[-4000:]
