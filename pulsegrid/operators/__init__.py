"""DataFrame operators over ordered frames."""
