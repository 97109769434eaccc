"""Column functions: Column -> Column, JVM-side."""
