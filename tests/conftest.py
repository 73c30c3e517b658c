import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("loanlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from loanlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


SAMPLE = dict(person_age=35, person_income=50000.0, person_home_ownership="OWN", person_emp_length=10.0,
              loan_intent="PERSONAL", loan_grade="A", loan_amnt=5000.0, loan_int_rate=0.08,
              loan_percent_income=0.1, cb_person_default_on_file=0, cb_person_cred_hist_length=8)

SERVE_SCHEMA = ("app_id bigint, person_age int, person_income double, person_home_ownership string, "
                "person_emp_length double, loan_intent string, loan_grade string, loan_amnt double, "
                "loan_int_rate double, loan_percent_income double, cb_person_default_on_file int, "
                "cb_person_cred_hist_length int")


@pytest.fixture
def records(spark):
    def make(*mutations):
        rows = []
        for i, m in enumerate(mutations):
            r = dict(SAMPLE, **m)
            rows.append((i, r["person_age"], r["person_income"], r["person_home_ownership"], r["person_emp_length"],
                         r["loan_intent"], r["loan_grade"], r["loan_amnt"], r["loan_int_rate"],
                         r["loan_percent_income"], r["cb_person_default_on_file"], r["cb_person_cred_hist_length"]))
        return spark.createDataFrame(rows, SERVE_SCHEMA)
    return make
