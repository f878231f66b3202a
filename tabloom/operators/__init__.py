"""tabloom operators."""
