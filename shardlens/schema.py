"""Codes, fixed lookup values and record schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Replica roles.
PRIMARY, SECONDARY, LEARNER, INVALID_ROLE = 0, 1, 2, 10001
ROLE_NAMES = {PRIMARY: "primary", SECONDARY: "secondary", LEARNER: "learner", INVALID_ROLE: "invalid"}

# Node admin operations.
NOOP, RESTART, OFFLINE = 0, 1, 2

# Every operator works for many services and many snapshots at once.
SCOPE = ["service", "snapshot_ts"]
TABLE_KEY = [*SCOPE, "table_id"]
PART_KEY = [*SCOPE, "table_id", "partition_id"]
NODE_KEY = [*SCOPE, "node_id"]
HUB_KEY = [*SCOPE, "hub_name"]
REPLICA_KEY = [*PART_KEY, "node_id"]

MAX_PARTS = 1048576
GIB = 1024 * 1024 * 1024

# Availability zone, its region, whether it is physical, and the virtual zone of a physical one.
AZ_ROWS = [
    ("STAGING", "STAGING", True, "STAGING"),
    ("YZ", "HB1", False, None),
    ("ZW", "HB1", False, None),
    ("SY", "HB1", False, None),
    ("HB1AZ1", "HB1", True, "ZW"),
    ("HB1AZ2", "HB1", True, "YZ"),
    ("HB1AZ3", "HB1", True, "ZW"),
    ("HB1AZ4", "HB1", True, "YZ"),
    ("HB2AZ1", "HB2", False, None),
    ("GZ1", "HN1", False, None),
    ("TXSGP1", "SGP", False, None),
    ("GCPSGPC", "SGP", False, None),
    ("TXVA2", "VA", False, None),
    ("SGPAZ1", "SGP", True, None),
    ("SGPAZ2", "SGP", True, None),
    ("SGPAZ3", "SGP", True, None),
    ("SGPAZ4", "SGP", True, None),
]
AZ_SCHEMA = "az string, region string, is_physical boolean, virtual_az string"


def az_dimension(spark: SparkSession) -> DataFrame:
    """The fixed zone dimension (17 rows, so always safe to broadcast)."""
    return spark.createDataFrame(AZ_ROWS, AZ_SCHEMA)


PEER = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("role", T.IntegerType()),
        T.StructField("ready_to_promote", T.BooleanType()),
        T.StructField("restore_version", T.LongType()),
        T.StructField("split_cleanup_version", T.IntegerType()),
        T.StructField("statistics", T.MapType(T.StringType(), T.StringType())),
    ]
)

REPORT_INFO = T.StructType(
    [
        T.StructField("table_id", T.LongType()),
        T.StructField("partition_id", T.LongType()),
        T.StructField("membership_version", T.LongType()),
        T.StructField("split_version", T.IntegerType()),
        T.StructField("peers", T.ArrayType(PEER)),
    ]
)

RESULT = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("message", T.StringType())])

REPORTS_RAW = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("snapshot_ts", T.LongType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("statistics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("results", T.ArrayType(RESULT)),
        T.StructField("infos", T.ArrayType(REPORT_INFO)),
    ]
)

MEMBERSHIP_JSON = (
    "membership_version bigint, split_version int, peers map<string,int>, restore_version map<string,bigint>"
)

PING_PAYLOAD = "node_id string, process_id bigint, biz_port int, node_index string"
