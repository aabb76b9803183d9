from pathlib import Path

from touchline.llm import queries


def test_every_query_is_tested_here():
    text = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py") if p.name != Path(__file__).name)
    assert not [k for k in queries.QUERIES if k != "pipeline" and k not in text]


def test_sql_belongs_to_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
