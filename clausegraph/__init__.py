"""clausegraph: structured-document retrieval analytics on Spark DataFrames.

* ``functions``  - reusable column expressions and word-level functions
* ``operators``  - layout, parsing, linking, graph, index, retrieval, verification
* ``sources``    - readers, writers and publish gate
* ``plans``      - registered queries and the DuckDB SQL they are held against
* ``streaming``  - micro-batch question answering and the audit sink
* ``llm``        - training-data operators; self-contained, nothing imports it
"""
