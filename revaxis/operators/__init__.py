"""DataFrame operators: reviews in, tidy report rows out, no actions inside."""
