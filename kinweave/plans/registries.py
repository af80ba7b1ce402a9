"""Two person registries derived from the customer and order tables; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans.runtime import table

LEFT_SQL = """
select c_custkey as a_id,
 concat(split_part('Avram|Estera|Mose|Elias|Hajnrih|Jozef|Salomon|Rivka|Izak|Ljubica|Rafael|Blanka','|',cast((c_custkey)%12 as int)+1),split_part('|na|ko|ta|el','|',cast((c_custkey*3+c_nationkey)%5 as int)+1),' ',split_part('Cohen|Altaras|Kabilio|Schwarz|Finci|Attias|Papo|Levi|Pollak|Weiss','|',cast((c_custkey*7+c_nationkey)%10 as int)+1)) as full_name,
 case when c_custkey%11=0 then '' else split_part('Avram|Estera|Mose|Elias|Hajnrih|Jozef|Salomon|Rivka|Izak|Ljubica|Rafael|Blanka','|',cast((c_custkey*5+c_nationkey)%12 as int)+1) end as father,
 case when c_custkey%13=0 then '' else cast(1880+(c_custkey*3+c_nationkey)%50 as varchar(4)) end as byear,
 case when c_custkey%17=0 then '' else split_part('Sarajevo|Zagreb|Beograd|Mostar|Zenica|Osijek|Tuzla','|',cast((c_nationkey)%7 as int)+1) end as place,
 case when c_custkey%19=0 then '' else cast(1941+c_custkey%5 as varchar(4)) end as dyear,
 concat('src ',cast(1880+(c_custkey*3+c_nationkey+c_custkey%4)%50 as varchar(4)),', ',lower(split_part('Sarajevo|Zagreb|Beograd|Mostar|Zenica|Osijek|Tuzla','|',cast((c_nationkey+1)%7 as int)+1)),', ',lower(split_part('Avram|Estera|Mose|Elias|Hajnrih|Jozef|Salomon|Rivka|Izak|Ljubica|Rafael|Blanka','|',cast((c_custkey*5+c_nationkey+c_custkey%2)%12 as int)+1))) as source
from customer
"""

RIGHT_SQL = """
select o_orderkey as b_id,
 case when o_orderkey%7=0 then split_part('Cohen|Altaras|Kabilio|Schwarz|Finci|Attias|Papo|Levi|Pollak|Weiss','|',cast((o_custkey*7+c_nationkey)%10 as int)+1) else concat(split_part('Avram|Estera|Mose|Elias|Hajnrih|Jozef|Salomon|Rivka|Izak|Ljubica|Rafael|Blanka','|',cast((o_custkey)%12 as int)+1),split_part('|na|ko|ta|el','|',cast((o_custkey*3+c_nationkey)%5 as int)+1)) end as given,
 case when o_orderkey%7=0 then concat(split_part('Avram|Estera|Mose|Elias|Hajnrih|Jozef|Salomon|Rivka|Izak|Ljubica|Rafael|Blanka','|',cast((o_custkey)%12 as int)+1),split_part('|na|ko|ta|el','|',cast((o_custkey*3+c_nationkey)%5 as int)+1)) when o_orderkey%5=0 then split_part('Kohen|Altaraz|Kabiljo|Svarc|Fincy|Atias|Pappo|Levy|Polak|Wajs','|',cast((o_custkey*7+c_nationkey)%10 as int)+1) else split_part('Cohen|Altaras|Kabilio|Schwarz|Finci|Attias|Papo|Levi|Pollak|Weiss','|',cast((o_custkey*7+c_nationkey)%10 as int)+1) end as surname,
 split_part('Avram|Estera|Mose|Elias|Hajnrih|Jozef|Salomon|Rivka|Izak|Ljubica|Rafael|Blanka','|',cast((o_custkey*5+c_nationkey+o_orderkey%3)%12 as int)+1) as father,
 case when o_orderkey%19=0 then '9999' else cast(1880+(o_custkey*3+c_nationkey+o_orderkey%3)%50 as varchar(4)) end as byear,
 split_part('Sarajevo|Zagreb-Centar|Beograd-Zemun|Mostar|Zenica|Osijek|Tuzla','|',cast((c_nationkey+o_orderkey%2)%7 as int)+1) as place,
 cast(1941+o_orderkey%5 as varchar(4)) as dyear,
 split_part('Sisak|Nepoznato|Jasenovac|Zemun|St. Gradiška|Beograd|Stara Gradiška logor','|',cast((o_orderkey)%7 as int)+1) as dplace, split_part('u logoru|na prisilnom radu|u borbi','|',cast((o_orderkey)%3 as int)+1) as circumstances
from orders join customer on o_custkey=c_custkey
"""


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    # names of tables become parameters, so no view of the session is touched
    text = sql.replace("from customer", "from {customer}").replace("from orders join customer", "from {orders} join {customer}")
    used = {n: f for n, f in frames.items() if "{" + n + "}" in text}
    return spark.sql(text, **used)


def left_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, LEFT_SQL)


def right_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RIGHT_SQL)


#: Both registries as SQL common table expressions.
WITH = f"with rega as ({LEFT_SQL}), regb as ({RIGHT_SQL})"
