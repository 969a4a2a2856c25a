"""Training-data pipeline operators: filtering, deduplication, tokenising, archiving.

Each module holds one operator with a general interface and its ``opN_<name>`` query;
``queries`` collects the queries and their SQL.  No module outside this folder imports it.
"""
