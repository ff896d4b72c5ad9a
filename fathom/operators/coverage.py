"""Choice of passages that keeps what is covered: a swap is made only if it adds a required term and loses none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fathom.functions import dialect
from fathom.operators import retrieval

#: Most passages of an answer, and of a question's pool (two lanes of 24).
CAP, POOL = 6, 48


def choose(holds: list[set], wanted: list, cap: int = CAP) -> list[int]:
    """Places in holds (term sets of passages, best first) of at most cap passages: the first ones, then, for each wanted term
    that they lack and a passage has, the best such passage in place of the lowest-ranked one whose terms the others keep."""
    kept = list(range(min(cap, len(holds))))
    for term in wanted:
        if any(term in holds[i] for i in kept):
            continue
        for new in (i for i in range(len(holds)) if term in holds[i]):
            if len(kept) < cap:
                kept.append(new)
                break
            covered = set().union(*(holds[i] for i in kept)) & set(wanted)
            for old in sorted(kept, reverse=True):
                rest = [i for i in kept if i != old] + [new]
                if covered <= set().union(*(holds[i] for i in rest)):
                    kept = rest
                    break
            else:
                continue
            break
    proofs = list(dict.fromkeys(min(i for i in kept if t in holds[i]) for t in wanted if any(t in holds[i] for i in kept)))
    return proofs + [i for i in sorted(kept) if i not in proofs]


def _one(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    holds = [set(t) for t in rows["terms"]]
    order = choose(holds, sorted(set().union(*holds)))
    return pd.DataFrame({"item_id": rows["item_id"].iloc[:1].repeat(len(order)).values, "doc_id": rows["doc_id"].values[order], "turn": range(1, len(order) + 1)})


POOLED = f"""{retrieval.FIRST}{retrieval.FUSED}, pool as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from fused) x where place <= {POOL}),
    shared as (select o.item_id, o.doc_id, o.place, a.term from pool o join idx_postings p on p.doc_id = o.doc_id join asked a on a.item_id = o.item_id and a.term = p.term where length(a.term) >= 5)
    select item_id, doc_id, cast(min(place) as bigint) as place, collect_set(term) as terms from shared group by item_id, doc_id"""


def coverage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, turn): at most six passages a question, covering all its long words that the best six did and more
    where a swap allows. A group is a question's pool, at most 48 rows."""
    sql = dialect(dialect(POOLED, 0), 0)
    retrieval.rated(spark, sf_dir, sql)
    return spark.sql(sql).groupBy("item_id").applyInPandas(_one, "item_id long, doc_id long, turn long")


QUERIES = {"coverage_selection": (coverage_selection, None)}
