"""The registered queries opN_<name>, one module each, with their DuckDB SQL."""
