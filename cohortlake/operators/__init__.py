"""DataFrame operators; import from the submodule that names the subject."""
