"""Every operator applied to the star-schema tables, with the same question asked in DuckDB SQL."""
