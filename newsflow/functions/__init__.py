"""Column functions: everything here maps Column -> Column and stays inside the JVM unless stated."""
