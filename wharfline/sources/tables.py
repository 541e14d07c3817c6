"""The star-schema tables bound to the library's tables. Each binding is a SQL text that Spark and other engines read alike.

A call is a customer's stay; its events, services and cargo are the lines of the customer's orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event names dealt to the lines.
EVENT_NAMES = (
    "ATA", "ATD", "ANCHORAGE_ARRIVAL", "PILOT_REQUEST_ARRIVAL", "PILOT_SCHEDULED_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "BREAKWATER_IN", "FIRST_LINE_TIED_ARRIVAL",
    "LAST_LINE_TIED_ARRIVAL", "ALL_FAST_ARRIVAL", "PILOT_DISEMBARK_ARRIVAL", "CARGO_START", "CARGO_END", "FIRST_LINE_UNTIED_SAILING", "LAST_LINE_UNTIED_SAILING",
    "PILOT_ON_BOARD_SAILING", "BREAKWATER_OUT", "SHIFT_PILOT_ON_BOARD", "SHIFT_ALL_FAST", "ETA", "ETD", "PORT_LIMIT_OUT", "TUG_SERVICE_START_ARRIVAL", "NOMINATION_SUBMITTED",
)
REASONS = ("Tug unavailable", "Pilot late", "Berth occupied", "High winds", "Crane fault", "Customs paperwork", "Change of shift", "", "Awaiting cargo", "Equipment failure", "Lines parted")

_LINE_ID = "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)))"
_EVENTS = " ".join(f"when {i} then '{n}'" for i, n in enumerate(EVENT_NAMES))
_REASON = " ".join(f"when {i} then '{r}'" for i, r in enumerate(REASONS))

BINDINGS = {
    "calls": """
        select c_custkey as call_id, c_name as vessel_name, concat('V', cast(c_custkey as varchar(20))) as vcn, c_mktsegment as tenant, n_name as port,
            case when c_custkey % 7 = 0 then null else concat('T', cast(n_regionkey as varchar(20))) end as terminal,
            case c_custkey % 4 when 0 then 'Container' when 1 then 'Container Feeder' when 2 then 'Bulk' else 'Tanker' end as vessel_type,
            case when c_acctbal < 0 then 'Breakbulk' when c_acctbal < 5000 then 'Containers' else 'Coal' end as cargo_type
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "events": f"""
        select o_custkey as call_id, case (l_partkey + l_linenumber) % {len(EVENT_NAMES)} {_EVENTS} end as event_name,
            cast(l_shipdate as timestamp) + interval '1' hour * (l_suppkey % 24) as utc, {_LINE_ID} as event_id,
            case l_partkey % 4 when 0 then 'AIS' when 1 then 'VTS' when 2 then 'Manual Log' else 'Radio' end as source_system,
            case l_suppkey % 3 when 0 then 'Verified' when 1 then 'Conflicting' else 'Unknown' end as verification_status,
            case when l_partkey % 11 = 0 then null else l_discount * 10 end as confidence, o_orderdate as created_at,
            l_partkey % 40 = 0 as is_superseded, l_suppkey % 45 = 0 as is_quarantined
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "services": f"""
        select o_custkey as call_id, {_LINE_ID} as service_id, case l_returnflag when 'A' then 'Arrival' when 'R' then 'Sailing' when 'N' then 'Shifting' end as movement,
            case l_linenumber % 4 when 0 then 'Pilotage' when 1 then 'Tug' when 2 then 'Berthing' else 'Bunkering' end as service_type,
            case when l_suppkey % 31 = 0 then null else o_orderdate end as submission,
            case when l_partkey % 37 = 0 then null else o_orderdate + interval '1' day * l_linenumber end as requested,
            case when l_partkey % 41 = 0 then null else o_orderdate + interval '1' day * (30 + l_suppkey % 60) end as scheduled,
            case when l_partkey % 43 = 0 then null else l_shipdate end as served
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "cargo": f"""
        select o_custkey as call_id, {_LINE_ID} as cargo_id, case l_returnflag when 'A' then 'TEU' when 'R' then 'MT' else 'Units' end as unit,
            case l_linenumber % 3 when 0 then 'Load/Discharge' when 1 then 'Unload' else 'Lashing' end as operation, l_quantity as quantity, l_quantity * 1.1 as planned,
            l_extendedprice / 1000 as working_hours, l_linenumber as resources, l_discount * 10 as downtime_hours
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "delays": f"""
        select o_custkey as call_id, {_LINE_ID} as delay_id, case l_returnflag when 'A' then 'Arrival' when 'R' then 'Sailing' else 'Shifting' end as movement,
            o_orderdate + interval '1' day * (30 + l_suppkey % 60) as scheduled, l_shipdate as served,
            case when l_partkey % 5 = 0 then null else round(date_part('day', l_shipdate - (o_orderdate + interval '1' day * (30 + l_suppkey % 60))) * 24.0 + l_tax - 0.02, 4) end as stated_hours,
            case l_suppkey % {len(REASONS)} {_REASON} end as reason,
            case l_linenumber when 1 then 'Marine Service' when 2 then 'Vessel' when 3 then 'Weather' when 4 then 'Documentation' when 5 then null else 'Operations' end as source_category,
            case l_linestatus when 'F' then 'Confirmed' else 'Reported' end as cause_status, case l_linenumber % 3 when 0 then 'High' when 1 then 'Medium' else 'Low' end as confidence_text
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def oracle(name: str) -> str:
    """The binding over tables of those names."""
    return BINDINGS[name].format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(BINDINGS[name], **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in BINDINGS[name]})
