"""Registered queries with their SQL counterparts."""


import functools


class Book:
    """Collects (name -> Spark callable) and (name -> SQL)."""

    def __init__(self):
        self.QUERIES, self.ORACLE = {}, {}

    def query(self, name, oracle=None):
        def add(fn):
            @functools.wraps(fn)
            def run(spark, sf_dir):
                spark.conf.set("spark.sql.session.timeZone", "UTC")     # the tables' zone-less times
                return fn(spark, sf_dir)

            self.QUERIES[name] = run
            if oracle:
                self.ORACLE[name] = oracle
            return fn
        return add
