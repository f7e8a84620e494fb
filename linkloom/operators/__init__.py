"""DataFrame → DataFrame operators, every key starting with the site."""
