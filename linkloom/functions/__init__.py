"""Column functions: URLs, words, texts, vectors. Everything here stays inside the JVM."""
