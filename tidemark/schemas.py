"""Explicit schemas: they are stated, never inferred."""

from pyspark.sql import types as T

PRICE, VOLUME, RATE = T.DecimalType(28, 8), T.DecimalType(28, 6), T.DecimalType(20, 10)


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


S, D, TS = T.StringType(), T.DateType(), T.TimestampType()

#: A raw daily bar of one provider, market, symbol and day.
DAILY_BAR = _fields(
    provider_id=S, dataset_key=S, market_code=S, native_symbol=S, trade_date=D, currency=S, open=PRICE, high=PRICE, low=PRICE, close=PRICE, volume=VOLUME, turnover=VOLUME,
    open_basis=S, high_basis=S, low_basis=S, close_basis=S, volume_basis=S, exchange_code=S, provider_security_id=S, source_data_version=S, identity_version=S,
    source_timestamp=TS, observed_at=TS, available_at=TS, availability_basis=S, raw_object_key=S,
)
#: A corporate action; prices are restated by its share multiplier.
ACTION = _fields(native_symbol=S, action_type=S, ex_date=D, split_from=PRICE, split_to=PRICE, adjustment_factor=PRICE, amount=PRICE)
