"""What to compute: stages, lead times, pairs, rules and KPIs. The rows are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Journey stages (name, sequence, start event, end event, time category, actor from, actor to, repeatable).
STAGES = [
    ("Pre-Arrival", 1, "NOMINATION_SUBMITTED", "ATA", "UNCLASSIFIED", "Vessel Agent", "TNPA Port Control", False),
    ("Anchorage Wait", 2, "ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "PASSIVE_WAIT", "TNPA Port Control", "Pilots", False),
    ("Inward Movement", 3, "PILOT_ON_BOARD_ARRIVAL", "ALL_FAST_ARRIVAL", "ACTIVE_SERVICE", "Pilots", "Mooring Team", False),
    ("Pilot Disembark Hold", 4, "ALL_FAST_ARRIVAL", "PILOT_DISEMBARK_ARRIVAL", "HOLD", "Mooring Team", "Pilots", False),
    ("Pre-Cargo Wait", 5, "PILOT_DISEMBARK_ARRIVAL", "CARGO_START", "PASSIVE_WAIT", "Berthing Master", "Terminal Cargo Teams", False),
    ("Cargo Operations", 6, "CARGO_START", "CARGO_END", "ACTIVE_SERVICE", "Terminal Cargo Teams", "Terminal Cargo Teams", False),
    ("Optional Shifting", 7, "SHIFT_PILOT_ON_BOARD", "SHIFT_ALL_FAST", "DELAY", "Pilots", "Mooring Team", True),
    ("Post-Cargo Wait", 8, "CARGO_END", "FIRST_LINE_UNTIED_SAILING", "PASSIVE_WAIT", "Terminal Cargo Teams", "Mooring Team", False),
    ("Unberthing", 9, "FIRST_LINE_UNTIED_SAILING", "LAST_LINE_UNTIED_SAILING", "ACTIVE_SERVICE", "Mooring Team", "Pilots", False),
    ("Departure Pilotage Wait", 10, "LAST_LINE_UNTIED_SAILING", "PILOT_ON_BOARD_SAILING", "PASSIVE_WAIT", "Berthing Master", "Pilots", False),
    ("Outward Movement", 11, "PILOT_ON_BOARD_SAILING", "BREAKWATER_OUT", "ACTIVE_SERVICE", "Pilots", "Vessel", False),
    ("Final Departure", 12, "BREAKWATER_OUT", "ATD", "UNCLASSIFIED", "Vessel", "TNPA Port Control", False),
    ("ISPS Clearance", 100, "ISPS Submission", "ISPS Clearance", "HOLD", "Police and Port Security", "TNPA Port Control", False),
    ("PHO Clearance", 101, "PHO Submission", "PHO Issuance", "HOLD", "PHO", "TNPA Port Control", False),
    ("IMDG Clearance", 102, "IMDG Submission", "IMDG Issuance", "HOLD", "Vessel Agent", "TNPA Port Control", False),
]
STAGE_SCHEMA = "stage string, sequence int, start_event string, end_event string, category string, actor_from string, actor_to string, repeatable boolean"
REPEATABLE = ("SHIFT_PILOT_ON_BOARD", "SHIFT_ALL_FAST")

# Events that must be in order (from, to, rule id).
SEQUENCE = [("ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "DQ-006"), ("PILOT_ON_BOARD_ARRIVAL", "PILOT_DISEMBARK_ARRIVAL", "DQ-SEQUENCE-VIOLATION")]

# Lead times (name, start event, end event); the last six have no source data.
LEAD_TIMES = [
    ("Turnaround", "ATA", "ATD", True),
    ("Anchorage Wait", "ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", True),
    ("Inward Movement", "PILOT_ON_BOARD_ARRIVAL", "ALL_FAST_ARRIVAL", True),
    ("Berth Stay", "ALL_FAST_ARRIVAL", "LAST_LINE_UNTIED_SAILING", True),
    ("Cargo Working", "CARGO_START", "CARGO_END", True),
    ("Outward Movement", "PILOT_ON_BOARD_SAILING", "BREAKWATER_OUT", True),
    ("Pre-Arrival", "NOMINATION_SUBMITTED", "ATA", True),
    ("Pilot Response Arrival", "PILOT_REQUEST_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", True),
    ("Breakwater In to All Fast", "BREAKWATER_IN", "ALL_FAST_ARRIVAL", True),
    ("First Line to All Fast", "FIRST_LINE_TIED_ARRIVAL", "ALL_FAST_ARRIVAL", True),
    ("Unberthing Duration", "FIRST_LINE_UNTIED_SAILING", "LAST_LINE_UNTIED_SAILING", True),
    ("Breakwater Out to ATD", "BREAKWATER_OUT", "ATD", True),
    ("Crane Start to Last Move", "FIRST_CRANE_MOVEMENT", "LAST_CRANE_MOVEMENT", False),
    ("First Container to ATD", "FIRST_CONTAINER_MOVEMENT", "ATD", False),
    ("Berthing End to Unmooring Start", "BERTHING_END", "UNMOORING_START", False),
    ("Lashing End to ATD", "LASHING_END", "ATD", False),
    ("Anchor Drop to Aweigh", "ANCHOR_DROP", "ANCHOR_AWEIGH", False),
    ("Truck Gate Turnaround", "GATE_IN", "GATE_OUT", False),
]
LEAD_TIME_SCHEMA = "metric string, start_event string, end_event string, computable boolean"
EXECUTION_DELAYS = [("Arrival Execution Delay", "Arrival"), ("Sailing Execution Delay", "Sailing")]

# Process stages ranked as bottlenecks (lead time, target hours).
BOTTLENECK_STAGES = [("Anchorage Wait", 2.0), ("Inward Movement", 2.5), ("Berth Stay", 48.0), ("Cargo Working", 36.0), ("Outward Movement", 2.0)]

# Outlier rules on event pairs (rule, start event, end event, kind, parameter).
OUTLIER_PAIRS = [
    ("OUT-V2-001", "ATA", "ATD", "HIGH", 0.90),
    ("OUT-V2-006", "ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "HIGH", 0.95),
    ("OUT-V2-010", "FIRST_LINE_TIED_ARRIVAL", "ALL_FAST_ARRIVAL", "SD", 3.0),
    ("OUT-V2-011", "ALL_FAST_ARRIVAL", "CARGO_START", "HIGH", 0.90),
    ("OUT-V2-012", "CARGO_END", "PILOT_ON_BOARD_SAILING", "HIGH", 0.90),
    ("OUT-V2-013", "CARGO_END", "LAST_LINE_UNTIED_SAILING", "HIGH", 0.90),
    ("OUT-V2-015", "FIRST_LINE_UNTIED_SAILING", "LAST_LINE_UNTIED_SAILING", "HIGH", 0.90),
    ("OUT-V2-024", "PILOT_ON_BOARD_ARRIVAL", "BREAKWATER_IN", "HIGH", 0.90),
    ("OUT-V2-025", "BREAKWATER_IN", "ALL_FAST_ARRIVAL", "HIGH", 0.90),
    ("OUT-V2-026", "BREAKWATER_OUT", "PORT_LIMIT_OUT", "HIGH", 0.90),
    ("OUT-V2-042", "FIRST_LINE_TIED_ARRIVAL", "LAST_LINE_TIED_ARRIVAL", "HIGH", 0.90),
]
OUTLIER_ALIASES = [("OUT-V2-019", "OUT-V2-024"), ("OUT-V2-020", "OUT-V2-012"), ("OUT-V2-043", "OUT-V2-015")]

# Delay categories.
DELAY_CATEGORIES = ["Pilot", "Tug", "Berth Non-Availability", "Weather", "Regulatory Clearance", "Terminal Readiness", "Cargo Operation", "Equipment Breakdown", "Crane Downtime", "Mooring", "Documentation", "Vessel-Side", "Port-Side", "External/Uncontrollable", "Other"]

# KPIs (code, name, category, unit, target, direction, green limit, amber limit, computed, alias of).
KPIS = [
    ("KPI-01", "Number of Vessel Calls", "Pre-arrival and anchorage", "calls", 75.0, "HIGHER", 70.0, 60.0, True, None),
    ("KPI-02", "Average Vessel Call Size", "Pre-arrival and anchorage", "TEU/call or MT/call", 15000.0, "HIGHER", 12000.0, 8000.0, True, None),
    ("KPI-03", "Average Pre-Berthing Waiting Time", "Pre-arrival and anchorage", "hours", 4.0, "LOWER", 5.0, 10.0, True, None),
    ("KPI-04", "Pre-Berthing Delay", "Pre-arrival and anchorage", "hours", 6.0, "LOWER", 6.0, 12.0, True, None),
    ("KPI-05", "Anchorage Time Variation Index", "Pre-arrival and anchorage", "hours", 2.0, "LOWER", 2.5, 5.0, True, None),
    ("KPI-06", "VTS Clearance Time", "Pre-arrival and anchorage", "hours", 0.5, "LOWER", 0.5, 1.0, False, None),
    ("KPI-07", "Average Inward Movement Time", "Inward movement", "hours", 1.5, "LOWER", 1.5, 2.5, True, None),
    ("KPI-08", "Average Inward Towage Duration", "Inward movement", "hours", 1.0, "LOWER", 1.2, 2.0, False, None),
    ("KPI-09", "Tug Availability", "Inward movement", "%", 98.0, "HIGHER", 95.0, 90.0, False, None),
    ("KPI-10", "Pilot Availability", "Inward movement", "%", 98.0, "HIGHER", 95.0, 90.0, False, None),
    ("KPI-11", "Tug Response Time", "Inward movement", "hours", 0.75, "LOWER", 0.8, 1.5, False, None),
    ("KPI-12", "Pilot Boarding Time", "Inward movement", "hours", 0.5, "LOWER", 0.5, 1.0, True, None),
    ("KPI-13", "Pilot-to-Berth Time", "Inward movement", "hours", 1.25, "LOWER", 1.3, 2.0, True, None),
    ("KPI-14", "Berth Occupancy Rate", "Berthing and at berth", "%", 65.0, "BAND", 70.0, 80.0, False, None),
    ("KPI-15", "Average Berthing Time", "Berthing and at berth", "hours", 24.0, "LOWER", 24.0, 48.0, True, None),
    ("KPI-16", "Berthing Time Variation Index", "Berthing and at berth", "hours", 12.0, "LOWER", 12.0, 24.0, True, None),
    ("KPI-17", "Average Non-Working Time at Berth", "Berthing and at berth", "hours", 4.0, "LOWER", 4.0, 8.0, True, None),
    ("KPI-18", "Idle Time at Berth", "Berthing and at berth", "%", 15.0, "LOWER", 15.0, 25.0, True, None),
    ("KPI-19", "Number of Vessel Shifts", "Berthing and at berth", "shifts", 8.0, "LOWER", 8.0, 15.0, True, None),
    ("KPI-20", "Shifting Time", "Berthing and at berth", "hours", 2.5, "LOWER", 2.5, 4.0, True, None),
    ("KPI-21", "Berth Productivity", "Berthing and at berth", "moves/crane-hr", 28.0, "HIGHER", 28.0, 22.0, True, None),
    ("KPI-22", "Berth Utilisation Ratio", "Berthing and at berth", "%", 55.0, "HIGHER", 55.0, 40.0, False, None),
    ("KPI-23", "Cargo Handled in MT", "Cargo handling", "MT", 500000.0, "HIGHER", 500000.0, 400000.0, True, None),
    ("KPI-24", "Container Traffic in TEUs", "Cargo handling", "TEU", 50000.0, "HIGHER", 50000.0, 35000.0, True, None),
    ("KPI-25", "Voyage Productivity", "Cargo handling", "moves/call", 2000.0, "HIGHER", 2000.0, 1200.0, True, None),
    ("KPI-26", "First Container Lift Time", "Cargo handling", "hours", 0.75, "LOWER", 0.75, 1.5, False, None),
    ("KPI-27", "Average Ship Berth-Day Output", "Cargo handling", "units/berth-day", 3500.0, "HIGHER", 3500.0, 2500.0, True, None),
    ("KPI-28", "Number of Cranes per Vessel", "Cargo handling", "cranes", 2.5, "HIGHER", 2.5, 2.0, True, None),
    ("KPI-29", "Equipment Downtime", "Cargo handling", "%", 3.0, "LOWER", 3.0, 6.0, True, None),
    ("KPI-30", "Crane Moves per Hour per Crane", "Cargo handling", "moves/crane-hr", 25.0, "HIGHER", 25.0, 20.0, True, None),
    ("KPI-31", "Import Container Dwell Time", "Yard operations", "days", 3.5, "LOWER", 3.5, 5.0, False, None),
    ("KPI-32", "Export Container Dwell Time", "Yard operations", "days", 2.5, "LOWER", 2.5, 4.0, False, None),
    ("KPI-33", "Yard Utilisation Rate", "Yard operations", "%", 70.0, "BAND", 75.0, 85.0, False, None),
    ("KPI-34", "Container Re-handling Rate", "Yard operations", "%", 12.0, "LOWER", 12.0, 18.0, False, None),
    ("KPI-35", "Yard Productivity", "Yard operations", "moves/crane-hr", 18.0, "HIGHER", 18.0, 14.0, False, None),
    ("KPI-36", "Truck Gate Turnaround", "Gate and landside", "minutes", 45.0, "LOWER", 45.0, 60.0, False, None),
    ("KPI-37", "Gate Transactions per Hour", "Gate and landside", "trucks/lane-hr", 30.0, "HIGHER", 30.0, 22.0, False, None),
    ("KPI-38", "Truck Waiting at Entry", "Gate and landside", "minutes", 15.0, "LOWER", 15.0, 30.0, False, None),
    ("KPI-39", "Rail Dwell Time", "Gate and landside", "hours", 12.0, "LOWER", 12.0, 18.0, False, None),
    ("KPI-40", "Rail Rake Handling Time", "Gate and landside", "hours", 4.0, "LOWER", 4.0, 6.0, False, None),
    ("KPI-41", "Turnaround Time", "Departure and turnaround", "hours", 36.0, "LOWER", 36.0, 60.0, True, None),
    ("KPI-42", "Berth Turnaround", "Departure and turnaround", "hours", 24.0, "LOWER", 24.0, 48.0, True, None),
    ("KPI-43", "Average Outward Movement", "Departure and turnaround", "hours", 1.25, "LOWER", 1.2, 2.0, True, None),
    ("KPI-44", "Average Outward Towage Duration", "Departure and turnaround", "hours", 0.8, "LOWER", 0.8, 1.5, False, None),
    ("KPI-45", "Outward Movements per Day", "Departure and turnaround", "departures/day", 4.0, "HIGHER", 4.0, 3.0, True, None),
    ("KPI-46", "Crane Availability Ratio", "Operational efficiency and coordination", "%", 95.0, "HIGHER", 95.0, 90.0, False, None),
    ("KPI-47", "Average Moves per Gang Shift", "Operational efficiency and coordination", "moves/gang-shift", 180.0, "HIGHER", 180.0, 140.0, False, None),
    ("KPI-48", "Unproductive Moves Ratio", "Operational efficiency and coordination", "%", 5.0, "LOWER", 5.0, 8.0, False, None),
    ("KPI-49", "Pilot Utilisation", "Resource utilisation", "%", 75.0, "BAND", 75.0, 85.0, False, None),
    ("KPI-50", "Tug Utilisation", "Resource utilisation", "%", 65.0, "BAND", 65.0, 75.0, False, None),
    ("KPI-51", "Berth Occupancy", "Resource utilisation", "%", 65.0, "BAND", 70.0, 80.0, False, "KPI-14"),
    ("KPI-52", "Crane Utilisation", "Resource utilisation", "%", 70.0, "BAND", 70.0, 80.0, False, None),
    ("KPI-53", "Average Tug Response", "Resource utilisation", "hours", 0.75, "LOWER", 0.8, 1.5, False, "KPI-11"),
    ("KPI-54", "Average Pilot Response", "Resource utilisation", "hours", 1.5, "LOWER", 1.5, 2.5, True, None),
    ("KPI-55", "Average Crane Downtime", "Resource utilisation", "hours/incident", 1.0, "LOWER", 1.0, 2.0, False, None),
]
# The systems whose data a KPI without source data would need.
REQUIRED_SYSTEMS = {
    "KPI-06": ["VTS_RADAR_LOG"],
    "KPI-08": ["TUG_SERVICE_RELEASE_LOG"],
    "KPI-09": ["TUG_FLEET_AVAILABILITY"],
    "KPI-10": ["PILOT_ROSTER_OR_AVAILABILITY"],
    "KPI-11": ["TUG_POSITION_OR_ARRIVAL_LOG"],
    "KPI-14": ["BERTH_INVENTORY_AND_AVAILABILITY"],
    "KPI-22": ["BERTH_INVENTORY_AND_AVAILABILITY"],
    "KPI-26": ["TOS_CRANE_LOG"],
    "KPI-31": ["YARD_TOS", "GATE_OCR"],
    "KPI-32": ["YARD_TOS", "GATE_OCR"],
    "KPI-33": ["YARD_TOS"],
    "KPI-34": ["YARD_TOS_EQUIPMENT"],
    "KPI-35": ["YARD_TOS_EQUIPMENT"],
    "KPI-36": ["GATE_OCR", "APPOINTMENT_SYSTEM"],
    "KPI-37": ["GATE_OCR"],
    "KPI-38": ["GATE_OCR", "ROAD_QUEUE_SENSORS"],
    "KPI-39": ["RAIL_OPERATOR_TOS"],
    "KPI-40": ["RAIL_OPERATOR_TOS"],
    "KPI-44": ["TUG_SERVICE_START_AND_RELEASE_LOG"],
    "KPI-46": ["TOS_ENGINEERING_SCADA"],
    "KPI-47": ["LABOUR_MANAGEMENT_SYSTEM"],
    "KPI-48": ["TOS_CRANE_LOG"],
    "KPI-49": ["PILOT_ROSTER_OR_AVAILABILITY"],
    "KPI-50": ["TUG_FLEET_AVAILABILITY"],
    "KPI-51": ["BERTH_INVENTORY_AND_AVAILABILITY"],
    "KPI-52": ["TOS_CRANE_LOG"],
    "KPI-53": ["TUG_POSITION_OR_ARRIVAL_LOG"],
    "KPI-55": ["CMMS_MAINTENANCE_LOG"],
}
KPI_SCHEMA = "kpi string, name string, category string, unit string, target double, direction string, green double, amber double, computed boolean, alias_of string"


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, STAGE_SCHEMA)


def lead_times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEAD_TIMES, LEAD_TIME_SCHEMA)


def kpis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KPIS, KPI_SCHEMA)


def required_systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUIRED_SYSTEMS.items()), "kpi string, required_systems array<string>")
