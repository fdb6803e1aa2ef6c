"""Operations of a training-data pipeline over tables of documents, pages and benchmarks.

Nothing outside this subpackage imports it; ``queries`` holds what ``__spark_entry__`` registers.
"""
