"""Operations of a training-data pipeline: one module per operation.

Nothing outside this package imports it; its queries and SQL are in
``docgrid.llm.queries``.
"""
