"""tidegauge: early-warning analytics for panel time series, written as Spark jobs.

Every table is keyed by ``entity_id``; series, vintages, forecast origins,
model runs and candidate configurations are key columns, never driver loops.
"""
