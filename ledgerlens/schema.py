"""The fixed ``customer_transactions`` schema.

Money is kept in exact decimals (``decimal(10,2)``), timestamps carry no
zone (``timestamp_ntz``), so no session time zone can shift a value.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

CT_SCHEMA = T.StructType(
    [
        T.StructField("cid", T.LongType(), False),
        T.StructField("tid", T.LongType(), False),
        T.StructField("gender", T.StringType(), True),
        T.StructField("age_group", T.StringType(), True),
        T.StructField("purchase_date", T.TimestampNTZType(), True),
        T.StructField("product_category", T.StringType(), True),
        T.StructField("discount_availed", T.BooleanType(), True),
        T.StructField("discount_name", T.StringType(), True),
        T.StructField("discount_amount_inr", MONEY, True),
        T.StructField("gross_amount", MONEY, True),
        T.StructField("net_amount", MONEY, True),
        T.StructField("purchase_method", T.StringType(), True),
        T.StructField("purchaselocation", T.StringType(), True),
        T.StructField("pay_date", T.TimestampNTZType(), True),
        T.StructField("client_name", T.StringType(), True),
    ]
)

CT_COLUMNS = [f.name for f in CT_SCHEMA.fields]

# Primary key of the table.
CT_KEY = ["cid", "tid"]

# The value domains offered by the reference's filters.
AGE_GROUPS = ["under 18", "18-25", "25-45", "45-60", "60 and above"]
GENDERS = ["Male", "Female", "Other"]


def conform(df):
    """Project ``df`` onto the table schema: column order and types.

    Extra columns are dropped, missing columns raise. Casting is a no-op
    when the input already has the right types, so Catalyst removes it.
    """
    missing = [c for c in CT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing customer_transactions columns: {missing}")
    return df.select(
        [df[f.name].cast(f.dataType).alias(f.name) for f in CT_SCHEMA.fields]
    )
