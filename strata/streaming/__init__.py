"""Structured Streaming entry points. The reference has no streaming operators; this
package only drives the existing batch loads from a stream of arriving bronze files."""
